"""Panel operators. Each takes and returns long DataFrames; parameters arrive as columns or plain values."""
