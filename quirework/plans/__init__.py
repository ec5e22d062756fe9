"""Whole conversions, and the query catalogue."""
