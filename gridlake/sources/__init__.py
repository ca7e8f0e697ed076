"""Reading and writing worksheets: CSV, JSON workbooks, XLSX, and tables."""
