"""Readers and writers of sequence and assay files."""
