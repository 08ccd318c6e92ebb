"""Event-log analytics on PySpark."""
