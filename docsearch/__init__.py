"""Search and analytics over document collections, on Spark DataFrames."""
