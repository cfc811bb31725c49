"""Tessera: a PySpark-native analytics engine (relational SQL, run-length frames, near-neighbour search)."""

__version__ = "0.1.0"
