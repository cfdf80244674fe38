"""Spindrift streaming."""
