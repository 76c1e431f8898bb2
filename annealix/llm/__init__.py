"""Training-data pipeline operators (quality, deduplication, tokens, safety scans).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
