"""Web-graph analytics and search on Spark DataFrames."""
