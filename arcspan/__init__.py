"""Vector search, evaluation analytics and corpus preparation on Spark DataFrames."""
