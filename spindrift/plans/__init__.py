"""Spindrift plans."""
