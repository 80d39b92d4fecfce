"""Profiling and cleaning of wide, sparse tables with Spark DataFrames."""
