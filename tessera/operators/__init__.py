"""Operators on DataFrames that Spark has no single call for."""
