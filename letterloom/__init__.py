"""Letterloom: mail search, mail analytics and training-data preparation on Spark DataFrames."""
