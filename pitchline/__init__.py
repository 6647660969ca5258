"""Point-in-time outcome analytics on Spark."""
