"""Labelled nearest-neighbour scoring and training-data operators on Spark."""
