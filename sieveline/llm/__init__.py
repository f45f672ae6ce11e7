"""Training-data operators. Nothing outside this subpackage imports it.

Ten operators, one module each, plus ``queries`` (what ``__spark_entry__``
registers) and ``common`` (shared folder and table helpers).
"""
