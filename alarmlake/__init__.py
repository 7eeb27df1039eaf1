"""Spark operators for alarm logs and sensor time series."""
