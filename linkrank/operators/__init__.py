"""Operators: DataFrames in, a DataFrame out, nothing written but checkpoints."""
