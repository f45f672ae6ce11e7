"""Replacements for found values, as functions of the value alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def digest(value: Column) -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex."""
    return F.sha2(value, 256)


def short_digest(value: Column) -> Column:
    return F.substring(digest(value), 1, 8)


def ip(value: Column) -> Column:
    """An address in 10.0.0.0/8 from the first three bytes of the digest; null for null."""
    byte = lambda n: F.conv(F.substring(digest(value), 2 * n + 1, 2), 16, 10)
    return F.concat(F.lit("10."), byte(0), F.lit("."), byte(1), F.lit("."), byte(2))


def email(value: Column) -> Column:
    return F.concat(F.lit("redacted-"), short_digest(value), F.lit("@example.com"))


def hostname(value: Column) -> Column:
    return F.concat(F.lit("host-"), short_digest(value), F.lit(".internal"))


GENERATORS = {"ip": ip, "email": email, "hostname": hostname}


def replacement(kind: str | None, value: Column) -> Column:
    """The replacement of ``value`` by a rule: a generator's, a fixed text, or the default for None."""
    if kind is None:
        return F.lit(REDACTED)
    return GENERATORS[kind](value) if kind in GENERATORS else F.lit(kind)
