"""Rules, mappings, files and events as DataFrames."""
