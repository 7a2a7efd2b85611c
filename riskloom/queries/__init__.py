"""Queries over the given tables, each with the SQL text that must give the same rows."""
