"""Training-data operators: each is a function of DataFrames, independent of the rest of the library."""
