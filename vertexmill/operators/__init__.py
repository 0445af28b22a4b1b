"""Operators, each from DataFrames to DataFrames."""
