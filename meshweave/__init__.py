"""meshweave: graph sampling, feature gathering and corpus preparation on Spark DataFrames."""
