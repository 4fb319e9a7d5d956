"""Relational operators, each a function from DataFrames to a DataFrame, with column names as parameters."""
