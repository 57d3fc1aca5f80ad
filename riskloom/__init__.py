"""Credit-risk analytics on Spark DataFrames."""
