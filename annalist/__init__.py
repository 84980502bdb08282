"""Version-control history analytics on Spark DataFrames."""
