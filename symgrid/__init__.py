"""Symbol and reference analytics on PySpark."""
