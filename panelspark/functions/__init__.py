"""Column functions: scalars, guarded statistics, ranks."""
