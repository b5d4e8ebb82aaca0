"""Operators over record tables: each takes and returns DataFrames."""
