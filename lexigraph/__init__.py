"""Graph-augmented retrieval and corpus processing on Spark DataFrames."""
