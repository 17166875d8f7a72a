"""Forecast-verification analytics as plain Spark DataFrame transformations."""
