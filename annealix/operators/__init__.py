"""Relational operators of the search."""
