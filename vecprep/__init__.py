"""Vector-dataset preparation and exact nearest-neighbour ground truth on Spark DataFrames."""
