"""Change analytics on Spark."""
