"""Registered query plans over the star-schema tables and their DuckDB counterparts."""
