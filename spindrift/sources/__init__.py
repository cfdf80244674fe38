"""Spindrift sources."""
