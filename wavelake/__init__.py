"""Signal analytics on Spark DataFrames."""
