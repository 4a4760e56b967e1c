"""The query catalogue: queries over a data directory and their DuckDB counterparts."""
