"""Oligo binding search and sequence analytics expressed as Spark DataFrames."""
