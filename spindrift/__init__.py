"""Spindrift: a PySpark-native engine for text corpora and model-evaluation data."""

__version__ = "0.1.0"
