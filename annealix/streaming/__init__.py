"""Continuous search of arriving sequence files."""
