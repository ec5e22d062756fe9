"""Readers and adapters that give primitives, lines and blocks."""
