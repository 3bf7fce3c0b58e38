"""Task-flow analytics on PySpark: as-of views, decisions and metrics over an append-only task log."""
