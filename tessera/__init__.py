"""Structural compression analytics and corpus preparation on Spark DataFrames."""
