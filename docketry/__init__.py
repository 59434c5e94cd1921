"""Search and analytics over large collections of structured decisions, on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns), for many queries and many documents at once.
"""

__version__ = "0.1.0"
