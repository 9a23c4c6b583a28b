"""DataFrame operators: each takes and returns DataFrames and holds no session."""
