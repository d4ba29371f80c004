"""Relational and time-series operators on DataFrames."""
