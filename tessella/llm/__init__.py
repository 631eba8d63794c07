"""Operators for large text corpora, kept apart from the tile engine."""
