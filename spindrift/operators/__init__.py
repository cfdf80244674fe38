"""Spindrift operators."""
