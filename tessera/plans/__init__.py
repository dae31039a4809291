"""Queries over the tables, each beside the SQL that states its result."""
