"""Spindrift functions."""
