"""Time-to-event analytics on Spark DataFrames."""
