"""Log-analytics operators for PySpark: ordered logs in, DataFrames out."""
