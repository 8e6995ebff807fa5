"""panelspark: ragged time x instrument analytics expressed as Spark DataFrames."""
