"""Order-flow analytics on Spark DataFrames."""
