"""Operators for building text corpora at scale. Nothing outside this package imports it."""
