"""Content analytics on Spark."""
