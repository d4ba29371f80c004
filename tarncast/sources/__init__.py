"""Readers and writers of the tables the forecasts live in."""
