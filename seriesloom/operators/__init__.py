"""Operators on panels of series: each takes and gives DataFrames."""
