"""Operators for preparing training data from text; nothing else in the library imports this."""
