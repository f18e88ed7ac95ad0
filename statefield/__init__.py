"""Discrete market-state analytics on Spark DataFrames."""
