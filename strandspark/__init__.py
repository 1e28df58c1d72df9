"""strandspark: DNA-archive analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
