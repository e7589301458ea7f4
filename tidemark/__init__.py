"""Point-in-time market research on Spark.

Every operator takes and returns DataFrames and stays lazy; see README.md for the map of modules.
"""
