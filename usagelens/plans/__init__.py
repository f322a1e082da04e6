"""Registered query plans: Spark callables and their DuckDB oracle SQL."""
