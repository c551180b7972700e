"""Counterfactual evidence analytics over code changes, on Spark DataFrames."""

__version__ = "0.1.0"
