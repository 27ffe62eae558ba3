"""Knowledge-graph retrieval and analytics on Spark DataFrames."""
