"""Training-data operators: sharding, filtering, deduplication, packing and formatting.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, is lazy except where a docstring names an action, and handles null
cells, empty tables, repeated rows and extra columns as its docstring says.
"""
