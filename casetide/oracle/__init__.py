"""DuckDB statements that restate each registered query independently."""
