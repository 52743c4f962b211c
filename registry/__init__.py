"""Queries over the driver tables, and the DuckDB statements that check them."""
