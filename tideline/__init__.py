"""Exposure-normalised event analytics as Spark DataFrame operators."""
