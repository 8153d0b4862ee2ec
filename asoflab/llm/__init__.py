"""Operators that prepare training data from text and embedding tables."""
