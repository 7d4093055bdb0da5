"""cohortlens — cohort and survival analytics on Spark DataFrames.

Every operator takes a DataFrame plus column names and returns a lazy DataFrame built from Spark SQL expressions,
joins, groupings and windows; see README.md for the design and the mapping to the operator inventory."""

__version__ = "0.1.0"
