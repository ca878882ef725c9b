"""Event-study analytics on Spark."""
