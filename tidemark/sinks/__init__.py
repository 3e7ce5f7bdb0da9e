"""Writing: dated Parquet folders, tables, pipeline state."""
