"""Local-discovery analytics on Spark: listings, places, distances, feeds and ranking.

Everything public is a function from DataFrames (or Columns) to DataFrames (or
Columns); the clock, the salt and every threshold are parameters.
"""
