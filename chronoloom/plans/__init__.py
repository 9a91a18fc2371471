"""Queries over the test tables, one per operator, each with its DuckDB twin where SQL can express it."""
