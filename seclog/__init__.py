"""seclog: security-log analytics as PySpark DataFrame and Structured Streaming jobs."""
