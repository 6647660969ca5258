"""Operators on DataFrames of matches and features."""
