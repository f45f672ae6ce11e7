"""Sensitive-text analytics on Spark: find, classify and redact by declarative rules."""
