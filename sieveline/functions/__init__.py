"""Column builders: regex dialect, spans, pseudonyms."""
