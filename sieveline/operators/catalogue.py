"""Scans with catalogues of thousands of rules.

``scan`` makes an expression of each rule, so its plan grows with the catalogue.
Here the plan stays as it is: an Aho-Corasick automaton over the texts that the
rules' matches can't do without goes through each text once, and only rules
whose text was found run their pattern. Literal rules are done with that pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect
from ..sources.rules import Rule, hash_text
from .scan import NONE, applies, in_pieces, once

#: Characters that one automaton (some 50 bytes each) is made of; a larger catalogue is scanned in parts.
PART_CHARACTERS = 2_000_000


@dataclass
class _Index:
    """A part of a catalogue as a worker uses it."""

    rules: list[tuple[int, Rule]]
    automaton: ahocorasick.Automaton | None = None
    always: list[int] = field(default_factory=list)
    digests: dict = field(default_factory=dict)
    compiled: dict = field(default_factory=dict)

    def __post_init__(self):
        words: dict = {}
        self.at = dict(self.rules)
        for n, rule in self.rules:
            if rule.hashed:
                if rule.hash_extractor:
                    self.digests.setdefault(rule.hash_extractor, {}).setdefault(rule.pattern, []).append(n)
            elif not rule.is_regex:
                words.setdefault(rule.pattern, ([], []))[0].append(n)
            elif need := dialect.needed(rule.pattern):
                words.setdefault(need, ([], []))[1].append(n)
            else:
                self.always.append(n)
        if words:
            self.automaton = ahocorasick.Automaton()
            for word, (literal, regex) in words.items():
                self.automaton.add_word(word, (len(word), literal, regex))
            self.automaton.make_automaton()

    def pattern(self, text: str) -> re.Pattern:
        if text not in self.compiled:
            self.compiled[text] = re.compile(text)
        return self.compiled[text]

    def spans(self, text: str, wanted) -> list[tuple[int, int, int, str | None]]:
        """``place of the rule, start, end, digest`` of all matches, by rule and from left to right."""
        found: dict = {}
        hit = set(self.always)
        for last, (length, literal, regex) in self.automaton.iter(text) if self.automaton else ():
            end, start = last + 1, last + 1 - length
            for n in literal:
                of = found.setdefault(n, [])
                if not of or start >= of[-1][1]:  # matches of one rule don't overlap
                    of.append((start, end, None))
            hit.update(regex)
        for n in hit:
            found[n] = [(*m.span(), None) for m in self.pattern(self.at[n].pattern).finditer(text)] if wanted(self.at[n]) else []
        for extractor, known in self.digests.items():
            for m in self.pattern(extractor).finditer(text):
                for n in known.get(digest := hash_text(m.group()), ()):
                    found.setdefault(n, []).append((*m.span(), digest))
        return [(n, *span) for n in sorted(found) if found[n] and wanted(self.at[n]) for span in found[n]]


#: The fields of a match as Arrow has them.
_FIELDS = {n: pa.int32() if n in ("ord", "start", "end") else pa.string() for n in ("ord", "rule_id", "action", "reason", "replacement", "start", "end", "text", "segment_hash")}
#: Indexes that a worker has made, by their catalogue's digest.
_made: dict[str, _Index] = {}


def _index(name: str, rules: list[tuple[int, Rule]]) -> _Index:
    if name not in _made:
        while len(_made) >= 4:
            del _made[next(iter(_made))]
        _made[name] = _Index(rules)
    return _made[name]


def _parts(rules: list[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    parts, size = [[]], 0
    for n, rule in rules:
        size += len(rule.pattern)
        if size > PART_CHARACTERS and parts[-1]:
            parts.append([])
            size = len(rule.pattern)
        parts[-1].append((n, rule))
    return parts


def _matcher(part: list[tuple[int, Rule]], spark):
    name = hashlib.sha256(repr(part).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(part)

    @F.arrow_udf(NONE)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = _index(name, sent.value)
        place = {n: i for i, (n, _) in enumerate(index.rules)}
        values = [pa.array([getattr(rule, k) for _, rule in index.rules], pa.string()) for k in ("id", "action", "reason", "replacement")]

        def columns(rows: list[tuple]) -> list:
            ords, starts, ends, digests, pieces = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            at = pa.array([place[n] for n in ords], pa.int32())
            return [ords, *(of.take(at) for of in values), starts, ends, pieces, digests]

        def spans(text: str | None, channel: str | None, tool: str | None) -> list[tuple]:
            wanted = lambda rule: rule.target in ("both", channel) and (rule.tool is None or rule.tool == tool)
            return [(*span, text[span[1] : span[2]]) for span in index.spans(text, wanted)] if text else []

        yield from in_pieces((spans(*(x.as_py() for x in row)) for batch in batches for row in zip(*batch, strict=True)), _FIELDS, columns)

    return found


def scan_catalogue(df: DataFrame, rules: list[Rule], text_column: str = "text", channel: Column | str = "tool", tool: Column | None = None, out: str = "matches") -> DataFrame:
    """What ``scan`` gives, for any number of rules: ``df`` with an array column ``out`` of all matches.

    The plan doesn't grow with the rules. Literal rules and patterns with a
    text that every match holds cost a text nothing unless it is found there;
    patterns without one run on every text. Hashed rules with one extractor
    share a pass over its segments and a lookup of their digests. A null or
    empty text has no matches, as no rule of a catalogue matches nothing;
    patterns that can are an error.
    """
    if len({rule.id for rule in rules}) < len(rules):
        raise ValueError("two rules share an id; merge them first")
    usable = [(n, rule) for n, rule in enumerate(rules) if rule.pattern and applies(rule, channel, tool) is not False]
    for _, rule in usable:
        if rule.is_regex and not rule.hashed and dialect.matches_nothing(rule.pattern):
            raise ValueError(f"rule '{rule.id}' can match nothing")
    as_column = lambda value: F.lit(value).cast("string") if value is None or isinstance(value, str) else value
    found = [_matcher(part, df.sparkSession)(F.col(text_column), as_column(channel), as_column(tool)) for part in _parts(usable)]
    return once(df, out, F.flatten(F.array(*found)) if len(found) > 1 else found[0])
