"""A document-graph query engine on Spark DataFrames."""
