"""Operators for training text and key streams; nothing else in the package depends on them."""
