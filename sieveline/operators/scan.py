"""Finding what rules match in a text column.

``scan`` adds an array of matches to each row without a shuffle; ``matches``
explodes it. Matches go by rule, then left to right, and may overlap across
rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect, spans
from ..functions.pseudonyms import digest
from ..sources.rules import Rule

MATCH = "struct<ord:int,rule_id:string,action:string,reason:string,replacement:string,start:int,end:int,text:string,segment_hash:string>"
NONE = f"array<{MATCH}>"
#: Hashed rules (some 100 bytes each) up to which a join sends them to all executors.
BROADCAST_RULES = 100_000
#: Digests up to which they are part of a plan, and up to which eight bytes of each are sent to all executors.
FEW_DIGESTS, MOST_DIGESTS = 1_000, 8_000_000


def no_matches() -> Column:
    return F.array().cast(NONE)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, worked out once in each row.

    A plain projection would be copied into every filter and projection that
    uses the column; the optimizer doesn't take a generator apart.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def applies(rule: Rule, channel: Column | str, tool: Column | None) -> Column | bool:
    """Whether a rule is for this channel and tool; decided on the driver where both are fixed."""
    if rule.tool is not None and tool is None:
        return False
    tests = []
    if rule.target != "both":
        if isinstance(channel, str):
            if rule.target != channel:
                return False
        else:
            tests.append(channel == F.lit(rule.target))
    if rule.tool is not None:
        tests.append(tool == F.lit(rule.tool))
    if not tests:
        return True
    test = tests[0]
    for more in tests[1:]:
        test = test & more
    return F.coalesce(test, F.lit(False))


#: Found values, and rows, that Python holds at most before they leave it as an Arrow array.
HELD, HELD_ROWS = 50_000, 10_000


def in_pieces(lists: Iterator[list[tuple]], fields: dict[str, pa.DataType], columns=None) -> Iterator[pa.Array]:
    """Lists of tuples, one for each row, as Arrow arrays of lists of structs of ``fields``; ``columns`` makes these of many tuples.

    An array ends after ``HELD`` tuples, however many a batch of rows has, so
    memory doesn't grow with what is found in a batch.
    """
    columns = columns or (lambda rows: list(zip(*rows, strict=True)) or [()] * len(fields))

    def array() -> pa.Array:
        made = [pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns(rows), fields.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(made, list(fields)))

    sizes, rows = [0], []
    for some in lists:
        sizes.append(len(some))
        rows += some
        if len(rows) >= HELD or len(sizes) > HELD_ROWS:
            yield array()
            sizes, rows = [0], []
    if len(sizes) > 1:
        yield array()


def as_match(rule: Rule, ord_: int, start: Column, end: Column, text: Column, segment_hash: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(ord_).alias("ord"),
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.action).alias("action"),
        F.lit(rule.reason).alias("reason"),
        (F.lit(rule.replacement) if rule.replacement is not None else null).alias("replacement"),
        start.alias("start"),
        end.alias("end"),
        text.alias("text"),
        (null if segment_hash is None else segment_hash).alias("segment_hash"),
    )


def pattern_spans(text: Column, pattern: str, keep=None) -> Column:
    """Spans of a Python pattern: by Spark's own functions if the pattern can be translated, else by Python."""
    java = dialect.to_java(pattern)
    return spans.java_spans(text, java, keep, dialect.needed(pattern)) if java else spans.python_spans(text, pattern, keep)


def _digest_among(digests: list[str]):
    return lambda text: digest(text).isin(*digests)


@dataclass
class _Extracted:
    """Columns with the segments of each extractor that some rule knows: one pass for all hashed rules that share it."""

    columns: dict = field(default_factory=dict)

    def add(self, df: DataFrame, rules: list[Rule], text: Column) -> DataFrame:
        known: dict = {}
        for rule in rules:
            if rule.hashed and rule.hash_extractor:
                known.setdefault(rule.hash_extractor, []).append(rule.pattern)
        for extractor, digests in known.items():
            self.columns[extractor] = name = unused(df, "segments")
            hashed = F.transform(pattern_spans(text, extractor, _digest_among(digests)), lambda s: s.withField("hash", digest(s["text"])))
            df = df.withColumn(name, hashed)
        return df


def _rule_matches(rule: Rule, ord_: int, text: Column, extracted: _Extracted) -> Column | None:
    if rule.hashed:
        if not rule.hash_extractor:
            return None
        same = F.filter(F.col(extracted.columns[rule.hash_extractor]), lambda s: s["hash"] == F.lit(rule.pattern))
        return F.transform(same, lambda s: as_match(rule, ord_, s["start"], s["end"], s["text"], s["hash"]))
    found = pattern_spans(text, rule.pattern if rule.is_regex else dialect.literal(rule.pattern))
    return F.transform(found, lambda s: as_match(rule, ord_, s["start"], s["end"], s["text"]))


def scan(df: DataFrame, rules: list[Rule], text_column: str = "text", channel: Column | str = "tool", tool: Column | None = None, out: str = "matches", when: dict | None = None, searched: str | None = None) -> DataFrame:
    """``df`` with an array column ``out`` of all matches of ``rules`` in ``text_column``.

    Rules without a pattern are left out. ``when`` may give a condition for a
    rule by its place in ``rules``. A null text has no matches. Two rules must
    not share an id. ``searched`` names a column that :func:`search` made with
    the same rules: a row whose text is the one searched there takes its
    matches from there, those of the rules that hold for the row.
    """
    if len({rule.id for rule in rules}) < len(rules):
        raise ValueError("two rules share an id; merge them first")
    text, extracted, parts = F.col(text_column), _Extracted(), []
    usable = [(n, rule, test) for n, rule in enumerate(rules) if rule.pattern and (test := applies(rule, channel, tool)) is not False]
    usable = [(n, rule, test if not when or n not in when else when[n] if test is True else test & when[n]) for n, rule, test in usable]
    if searched:
        left, before = unused(df, "unsearched"), F.col(searched)
        same = F.coalesce(before["text"] == text, F.lit(False))
        # without a text no rule has work to do
        df, text = df.withColumn(left, F.when(~same, text)), F.col(left)
    df = extracted.add(df, [rule for _, rule, _ in usable], text)
    for n, rule, test in usable:
        found = _rule_matches(rule, n, text, extracted)
        if found is not None:
            parts.append(F.coalesce(found if test is True else F.when(test, found), no_matches()))
    found = F.flatten(F.array(*parts)) if parts else no_matches()
    if searched:
        always = [n for n, _, test in usable if test is True]
        sometimes = [F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, _, test in usable if test is not True]
        holding = F.array(*map(F.lit, always), *sometimes).cast("array<int>")
        found = F.when(same, F.filter(before["matches"], lambda m: F.exists(holding, lambda n: n == m["ord"]))).otherwise(found)
        return once(df, out, found).drop(*extracted.columns.values(), left)
    return once(df, out, found).drop(*extracted.columns.values())


def search(df: DataFrame, rules: list[Rule], text_column: str = "text", out: str = "searched") -> DataFrame:
    """``df`` with a column ``out (text, matches)``: a text that several rows will hold, searched once for all rules, whatever channel and tool they are for."""
    found = unused(df, "found")
    df = scan(df, [replace(rule, target="both", tool=None) for rule in rules], text_column, out=found)
    return df.withColumn(out, F.struct(F.col(text_column).alias("text"), F.col(found).alias("matches"))).drop(found)


def matches(df: DataFrame, columns: list[str], out: str = "matches") -> DataFrame:
    """A row for each match, with its place among the row's matches in ``mord``."""
    return df.select(*columns, F.posexplode(out).alias("mord", "match")).select(*columns, "mord", "match.*")


#: Digests' prefixes that a worker remembers by their segments, up to a length that words have.
REMEMBERED, WORD_LENGTH = 100_000, 64


def _known_spans(known: DataFrame, text: Column, extractor: str) -> Column:
    """The spans of a text's segments whose digest may be in ``known (segment_hash)``, by the digests' first 15 digits.

    Python goes through a text once and hashes a word once in a worker; only
    segments that may be known leave it.
    """
    prefix = F.conv(F.substring("segment_hash", 1, 15), 16, 10).cast("bigint")
    sent = known.sparkSession.sparkContext.broadcast(np.unique(known.select(prefix.alias("p")).distinct().toArrow()["p"].to_numpy()))
    pattern, remembered = re.compile(extractor), {}

    def may_be_known(segment: str) -> bool:
        found = remembered.get(segment)
        if found is None:
            p = int(sha256(segment.encode()).hexdigest()[:15], 16)
            at = int(np.searchsorted(sent.value, p))
            found = at < len(sent.value) and int(sent.value[at]) == p
            if len(segment) <= WORD_LENGTH:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                remembered[segment] = found
        return found

    def segments(text: str | None) -> list[tuple]:
        return [(*m.span(), m.group()) for m in pattern.finditer(text) if may_be_known(m.group())] if text is not None else []

    @F.arrow_udf(spans.NONE)
    def among(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = {"start": pa.int32(), "end": pa.int32(), "text": pa.string()}
        yield from in_pieces((segments(text.as_py()) for texts in batches for text in texts), fields)

    return among(text)


def hashed_hits(df: DataFrame, rules: DataFrame, extractor: str, columns: list[str], text_column: str = "text", few: int = FEW_DIGESTS, most: int = MOST_DIGESTS) -> DataFrame:
    """Rows for the segments whose digest is in a table of hashed rules: ``columns``, the span, ``segment_hash`` and ``rule_id``.

    Segments are looked for in the row first, and only those that may be known
    are joined to ``rules (rule_id, pattern)``: up to ``few`` digests are part
    of the plan; up to ``most``, eight bytes of each are sent to all
    executors, and Python finds the segments in one pass; of more, all
    segments are joined. Up to
    ``BROADCAST_RULES`` rules are sent to all executors for the join.
    """
    known = rules.where("hashed").where(F.col("hash_extractor") == extractor).select("rule_id", F.col("pattern").alias("segment_hash"))
    n, text = known.count(), F.col(text_column)
    if n <= few:
        found = pattern_spans(text, extractor, _digest_among([x for (x,) in known.select("segment_hash").distinct().collect()]))
    else:
        found = _known_spans(known, text, extractor) if n <= most else pattern_spans(text, extractor)
    segments = df.select(*columns, F.explode(found).alias("s")).select(*columns, "s.*", digest(F.col("s.text")).alias("segment_hash"))
    return segments.join(F.broadcast(known) if n <= BROADCAST_RULES else known, "segment_hash")
