"""Operators for preparing training text.  Nothing else in the toolkit imports this."""
