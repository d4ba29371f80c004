"""Set-based probabilistic forecasting of daily environmental series on Spark."""
