"""Immutable sorted key-value data on Spark."""
