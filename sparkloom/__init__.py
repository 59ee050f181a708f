"""Hybrid document retrieval and text analytics on Spark DataFrames."""
