"""Training-data operators. Nothing else in panelspark imports this subpackage."""
