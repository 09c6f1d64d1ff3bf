"""Governed knowledge analytics on Spark."""
