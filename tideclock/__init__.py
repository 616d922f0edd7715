"""Process-clock and event-replay analytics on PySpark."""
