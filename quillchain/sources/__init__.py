"""Corpus sources and the stored model."""
