"""Relational operators over DataFrames, with the columns as parameters."""
