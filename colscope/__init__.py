"""Column profiling and column relations for tables of mixed types, on Spark DataFrames."""
