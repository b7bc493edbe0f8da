"""Ordered, versioned key-value data on Spark DataFrames."""
