"""Operators by subject; each is a function from DataFrames to a DataFrame."""
