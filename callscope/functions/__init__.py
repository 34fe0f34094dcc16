"""Scalar functions, as Column expressions wherever Spark has the parts."""
