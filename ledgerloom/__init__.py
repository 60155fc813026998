"""Multidimensional fact analytics on Spark."""
