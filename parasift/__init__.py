"""parasift: corpus extraction, segment selection and summarisation on Spark.

Every operator is DataFrame in, DataFrame out.  See README.md for the map of
operators to modules.
"""

__version__ = "0.1.0"
