"""Region-level analytics as Spark DataFrame jobs."""
