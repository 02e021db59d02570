"""Operators on DataFrames and on schema trees."""
