"""Evidence retrieval and verification analytics on Spark DataFrames."""
