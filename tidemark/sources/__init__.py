"""Reading: databases over JDBC, dated Parquet folders, tables."""
