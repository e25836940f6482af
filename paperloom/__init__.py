"""News-text analytics on Spark DataFrames: scans, text columns, joins, statistics, ranking, streaming."""

__version__ = "0.1.0"
