"""Versioned, content-addressed analytics on Spark DataFrames."""
