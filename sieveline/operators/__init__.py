"""DataFrame operators: scanning, path matching, decisions, the mapping table."""
