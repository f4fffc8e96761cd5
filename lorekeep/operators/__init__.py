"""Operators: each a function from DataFrames and parameters to a DataFrame."""
