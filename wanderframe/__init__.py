"""Random-walk graph analytics on Spark DataFrames."""
