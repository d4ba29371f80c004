"""Forecast models, scoring and evaluation, each a function of DataFrames to a DataFrame."""
