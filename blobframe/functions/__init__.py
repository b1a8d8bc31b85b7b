"""Column functions of the store."""
