"""Operators over DataFrames: histograms, chains, marginals, state space, inference."""
