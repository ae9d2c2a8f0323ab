"""Memory-bank anomaly analytics over images and vectors, on Spark DataFrames."""
