"""Quality rules as a short-circuit cascade.

Each rule looks at one text and rejects it or not; a document is kept if no
rule rejects it, so the order never changes the verdict. It changes the cost:
on a bounded sample every rule is run alone, its time and its rejections are
measured, and the rules then run by rejections per second, each only on what
the earlier ones let through.
"""

from __future__ import annotations

import posixpath
import random
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rows of the sample on which cost and selectivity are measured, and files that it is drawn from.
SAMPLE_ROWS, SAMPLE_FILES = 2_000, 8

_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))


class Measures:
    """What rules ask of a text; each is worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def _count(self, characters: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, characters))

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        """Runs of anything but the six ASCII white space characters."""
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self._count(_SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return self._count(_SYMBOLS)

    @cached_property
    def n_exclamations(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def n_upper(self) -> int:
        return self._count(_UPPER)

    @cached_property
    def n_lower(self) -> int:
        return self._count(_LOWER)

    @cached_property
    def worded_lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.worded_lines) - len(set(self.worded_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a three-word window found twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts, repeated, end = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
        return repeated


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` is true for a text that has to go."""

    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
#: Shares are compared as integers, so that SQL gives the same verdicts.
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 7 * len(m.worded_lines)),
    Rule("shouting", lambda m: m.n_upper > m.n_lower),
    Rule("exclamations", lambda m: 5 * m.n_exclamations > m.n_words),
    Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 20 * m.n_words),
)
RULES = BASE_RULES + MORE_RULES


def rejected_by(text: str | None, rules) -> str | None:
    """Name of the first of ``rules`` that rejects ``text``; later ones don't run."""
    measures = Measures(text)
    return next((rule.name for rule in rules if rule.rejects(measures)), None)


def _sampled(docs: DataFrame, sample_rows: int, seed: int, text_column: str) -> DataFrame:
    """About ``sample_rows`` texts. Of a table in files only some files are read, drawn by the seed."""
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        try:
            names = [unquote(posixpath.basename(file)) for file in random.Random(seed).sample(files, SAMPLE_FILES)]
            docs = docs.where(F.col("_metadata.file_name").isin(names))
        except AnalysisException:  # not a plain table of files: rows are drawn from all of it
            pass
    rows, texts = docs.count(), docs.select(text_or_empty(text_column).alias("text"))
    return texts.sample(fraction=sample_rows / rows, seed=seed) if rows > sample_rows else texts


def cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 17, text_column: str = "text", given: tuple = (), before=()) -> list[Rule]:
    """``rules`` by rejections per second, as measured on about ``sample_rows`` rows.

    ``given`` names measures that are there when the rules run, and ``before``
    rules that run before these: what they reject isn't looked at. Only a line
    for each rule comes to the driver. Rules that reject nothing there come
    last, the cheapest first.
    """

    def ready(text: str) -> Measures:
        m = Measures(text)
        for name in given:
            getattr(m, name)
        return m

    def measure(batches):
        for batch in batches:
            texts, found = [t for t in batch.column(0).to_pylist() if not rejected_by(t, before)], []
            for rule in rules:
                measures = [ready(text) for text in texts]
                began = time.perf_counter()
                rejections = sum(map(rule.rejects, measures))
                found.append({"rule": rule.name, "seconds": time.perf_counter() - began, "rejections": rejections})
            yield pa.RecordBatch.from_pylist(found)

    sample = _sampled(docs, sample_rows, seed, text_column)
    measured = sample.mapInArrow(measure, "rule string, seconds double, rejections bigint").groupBy("rule").agg(F.sum("seconds"), F.sum("rejections"))
    figures = {name: (rejections / max(seconds, 1e-9), -seconds) for name, seconds, rejections in measured.collect()}
    return sorted(rules, key=lambda rule: figures.get(rule.name, (0.0, 0.0)), reverse=True)


def filter_quality(docs: DataFrame, rules=RULES, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text has no words and is rejected where an empty one is. Repeated
    rows are judged alike; an empty table stays empty.
    """
    ordered, at = cascade(docs, rules, text_column=text_column), docs.columns.index(text_column)

    def keep(batches):
        for batch in batches:
            kept = [rejected_by(text, ordered) is None for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def measure_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the base figures, ``base_failed`` and ``kept`` of every row.

    The base figures are made for every text; the other rules run as a cascade
    on the texts that pass the base rules. A null text is one without words,
    an empty one too; texts of any length are measured whole; repeated rows get
    the same figures. An empty table gives an empty result; other columns are
    left out, whatever their names.
    """
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ordered = cascade(docs, MORE_RULES, text_column=text_column, given=figures, before=BASE_RULES)
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in figures), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                failed = any(rule.rejects(m) for rule in BASE_RULES)
                rows.append((*(getattr(m, name) for name in figures), failed, not failed and not any(rule.rejects(m) for rule in ordered)))
            columns = zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, " + "".join(f"{name} bigint, " for name in figures) + "base_failed boolean, kept boolean")


#: DuckDB: the same figures and verdicts from lists and windows.
MEASURE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
again AS (SELECT r, unnest(list(i)) AS i FROM (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS v FROM win)
          GROUP BY r, v HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS g(k) GROUP BY r),
f AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bang,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 7 * n_lines
            OR n_upper > n_lower OR 5 * n_bang > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""
