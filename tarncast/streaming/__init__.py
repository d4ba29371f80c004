"""Continuous forms of the daily roll-up, the latest value and scoring."""
