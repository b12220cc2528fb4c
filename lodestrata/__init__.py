"""Profiling, cleaning and comparing large tables with Spark DataFrames."""
