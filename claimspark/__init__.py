"""Construction-claims analytics on PySpark."""
