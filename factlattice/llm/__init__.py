"""Operators for preparing training data; see README.md for the list."""
