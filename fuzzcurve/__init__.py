"""Curve, profiling and fuzzy-feature analytics on Spark DataFrames."""
