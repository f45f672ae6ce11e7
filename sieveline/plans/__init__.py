"""Whole decisions for files and events."""
