"""Operators for preparing training text: duplicates, quality, contamination, tokens, order."""
