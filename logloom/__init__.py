"""Event-log analytics as Spark DataFrame jobs."""
