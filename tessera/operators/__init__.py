"""Relational operators of the event study."""
