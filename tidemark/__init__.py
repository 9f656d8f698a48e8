"""Point-in-time panel analytics, built on Spark DataFrames."""
