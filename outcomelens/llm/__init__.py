"""Operators for building training data: each takes DataFrames and returns DataFrames."""
