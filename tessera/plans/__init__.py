"""Registered queries over the provided tables, with their DuckDB statements."""
