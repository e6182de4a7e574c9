"""The operators of a query, each a function from DataFrames to a DataFrame."""
