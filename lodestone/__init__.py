"""A document retrieval and analytics engine on Spark DataFrames."""
