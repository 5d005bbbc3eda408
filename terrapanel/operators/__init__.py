"""Table-level operators: DataFrame in, DataFrame (or a few scalars) out."""
