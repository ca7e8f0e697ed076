"""Structured Streaming over event tables: an extension, spreadsheets have no streams."""
