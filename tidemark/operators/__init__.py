"""Operators over DataFrames. Column names are parameters; results are lazy unless a docstring says otherwise."""
