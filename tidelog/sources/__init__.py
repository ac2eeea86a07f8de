"""Binary logs as DataFrames, and Parquet logs that are appended to."""
