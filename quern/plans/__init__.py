"""Registered queries with their DuckDB twins, and checks of physical plans."""
