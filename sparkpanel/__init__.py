"""Panel time-series analytics on PySpark."""
