"""Parsers of start lists and result lists: text in, rows out."""
