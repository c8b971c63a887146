"""Operators on DataFrames, and the kernels that they run in workers."""
