"""A property-graph query and analytics engine on Spark DataFrames."""
