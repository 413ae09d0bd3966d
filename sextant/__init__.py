"""Sextant: time-series research and corpus preparation on PySpark."""
