"""Operators on whole DataFrames; each module is one family."""
