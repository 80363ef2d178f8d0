"""Shape comparison and corpus preparation on Spark DataFrames."""
