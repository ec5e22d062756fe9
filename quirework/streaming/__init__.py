"""Conversion of documents as they arrive."""
