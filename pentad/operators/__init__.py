"""Operators on DataFrames: index building, neighbour search, votes, evaluation, run summaries."""
