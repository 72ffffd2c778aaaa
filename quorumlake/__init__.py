"""Nearest-neighbour fraud analytics and training-data operators on Spark DataFrames."""
