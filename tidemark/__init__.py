"""Marketing analytics as Spark DataFrame jobs."""
