"""Continuous form of the load."""
