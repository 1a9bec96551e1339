"""Market-state analytics on ordered price bars, built on Spark DataFrames."""
