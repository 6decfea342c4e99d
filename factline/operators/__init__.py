"""Operators over DataFrames: joins, grouping, windows."""
