"""Operators: DataFrames in, DataFrames out, keyed by graph_id throughout."""
