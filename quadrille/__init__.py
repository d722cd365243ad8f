"""Knowledge-graph analytics for file archives on Spark DataFrames."""
