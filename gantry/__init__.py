"""Gantry: repository analytics and corpus operators on Spark DataFrames."""
