"""Probabilistic analytics over Spark DataFrames."""
