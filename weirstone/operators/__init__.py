"""Pure operators: DataFrames in, DataFrames out; no reading, writing or actions."""
