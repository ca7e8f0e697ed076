"""Spreadsheet analytics on Spark: formulas, lookups, criteria and dynamic arrays over DataFrames."""
