"""Source-corpus analytics on Spark DataFrames."""
