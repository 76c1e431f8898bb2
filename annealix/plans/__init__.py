"""End-to-end searches."""
