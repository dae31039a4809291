"""Column functions that Spark has no single call for."""
