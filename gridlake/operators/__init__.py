"""Spreadsheet operators over DataFrames, usable without formulas."""
