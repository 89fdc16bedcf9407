"""Column functions that the operators are built of."""
