"""Operators over ordered logs: DataFrames in, a DataFrame out."""
