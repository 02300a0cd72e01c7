"""Verdicts on streaming score tables."""
