"""Evidence retrieval, news clustering and point-in-time market analytics as Spark DataFrames."""
