"""Operators for building training data, one module each; nothing else in the library imports them."""
