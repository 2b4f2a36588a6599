"""Document analytics on Spark: every operator is a function from DataFrames to a DataFrame."""
