"""Reading raw quarterly files and keeping the cleaned Parquet tables."""
