"""Scans of files of any size, by ranges of their bytes.

``scan`` needs a file's whole text in one row, which Spark bounds at 2 GB.
Here each file is cut into ranges and a task reads some of them. Every rule has
its own seam near the end of a range, which both neighbours find alike: a place
that no match of the rule can go across. Matches are therefore those of the
whole file, and each is found once.

- A rule whose matches stay within a line is cut after a line's end, whatever
  their length: a task reads on until one comes.
- A rule whose matches and looks around span at most ``REACH`` characters is
  cut at the first place that no match begun in the ``REACH`` characters before
  it would go across.
- Others (no bound, and lines may end inside) run on the file as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialect
from ..sources.files import text_files
from ..sources.rules import Rule, hash_text
from .scan import matches, scan

#: Bytes of a range: a task holds them, their text and what is around.
RANGE = 32 << 20
#: Characters that matches of rules that cross lines may span to be found by ranges.
REACH = 4096
#: Tasks that ranges are dealt to at most; more ranges than that take turns.
TASKS = 20_000
#: Bytes by which a task reads on where a range's last seam isn't yet found.
_MORE = 64 << 10

_FOUND = "path string, n bigint, n_chars bigint, valid boolean, spans array<struct<ord:int,start:int,end:int,text:string,segment_hash:string>>"
_RESULT = ["path", "ord", "rule_id", "action", "reason", "replacement", "start", "end", "text", "segment_hash"]


def open_file(path: str) -> BinaryIO:
    """A file by the path that Spark gives it, in the stores that Arrow knows."""
    local = re.match("file:(?://)?(/.*)", path, re.DOTALL)
    if local:
        return fs.LocalFileSystem().open_input_file(local[1])
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inside)


@dataclass(frozen=True)
class _Cut:
    """A rule's pattern and how its seams are found: after a line's end, or with ``reach`` characters around."""

    ord: int
    pattern: str
    digest: str | None
    reach: int | None


def _cut(ord_: int, rule: Rule) -> _Cut | None:
    """None for a rule that needs the whole file."""
    pattern = rule.hash_extractor if rule.hashed else rule.pattern if rule.is_regex else dialect.literal(rule.pattern)
    digest = rule.pattern if rule.hashed else None
    if dialect.within_line(pattern):
        return _Cut(ord_, pattern, digest, None)
    most = dialect.reach(pattern)
    if most is None or most > REACH or dialect.matches_nothing(pattern):
        return None
    return _Cut(ord_, pattern, digest, most)


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


class _Around:
    """The text around a range of a file's bytes; it grows to the right on demand."""

    def __init__(self, file: BinaryIO, size: int, begin: int, end: int, left: int, more: int):
        self.file, self.size, self.begin, self.end, self.more = file, size, begin, end, more
        self.low = max(0, begin - left)
        file.seek(self.low)
        self.data = file.read(min(size, end + 3 + more) - self.low)
        if self.low:  # begins with a whole character, and not between the two that end a line
            skip = self._continued(0)
            skip += self.data[skip : skip + 1] == b"\n" and skip < begin - self.low
            self.low, self.data = self.low + skip, self.data[skip:]
        self._read()

    def _continued(self, at: int) -> int:
        """Bytes at a place that belong to a character begun before it."""
        n = 0
        while n < 3 and at + n < len(self.data) and self.data[at + n] & 0xC0 == 0x80:
            n += 1
        return n

    def _place(self, byte: int) -> int:
        at = byte - self.low
        return at + (self._continued(at) if at > 0 else 0)

    def _read(self) -> None:
        self.text = _plain(self.data)
        self.first, self.last = (len(_plain(self.data[: self._place(b)])) for b in (self.begin, self.end))

    @property
    def whole(self) -> bool:
        """Whether the text goes on to the file's end."""
        return self.low + len(self.data) >= self.size

    def grow(self) -> None:
        self.file.seek(self.low + len(self.data))
        self.data += self.file.read(self.more)
        self.more *= 2
        self._read()

    def valid(self) -> bool:
        try:
            self.data[self._place(self.begin) : self._place(self.end)].decode()
        except UnicodeDecodeError:
            return False
        return True


def _after_line(text: str, at: int, _) -> int | None:
    end = text.find("\n", at)
    return None if end < 0 else end + 1


def _uncrossed(reach: int):
    def seam(text: str, at: int, pattern: re.Pattern) -> int | None:
        begin = max(0, at - reach)
        furthest = begin
        for place in range(begin, len(text) - reach - 1):
            if place >= at and furthest <= place:
                return place
            if found := pattern.match(text, place):
                furthest = max(furthest, found.end())
        return None

    return seam


def _own(around: _Around, cut: _Cut) -> list[tuple[int, int, str]]:
    """A rule's matches that begin between the range's seams; places count from the range's first character."""
    pattern = re.compile(cut.pattern)
    seam = _after_line if cut.reach is None else _uncrossed(cut.reach)

    def place(of: str) -> int | None:
        """None for the file's end."""
        while True:
            found = seam(around.text, getattr(around, of), pattern)
            # What ends a line is looked at from before it, so two more characters have to be there.
            if found is not None and (around.whole or found + (cut.reach or 0) + 2 <= len(around.text)):
                return found
            if around.whole:
                return None
            around.grow()

    begin = place("first") if around.begin else 0
    if begin is None:
        return []
    end = place("last") if around.end < around.size else None
    out = []
    for m in pattern.finditer(around.text, begin):
        if end is not None and m.start() >= end:
            break
        out.append((m.start() - around.first, m.end() - around.first, m.group()))
    return out


def range_spans(file: BinaryIO, size: int, begin: int, end: int, cuts: list[_Cut], more: int = _MORE) -> dict:
    """What one range of a file holds: its characters, whether they are UTF-8, and the spans of the rules that begin in it."""
    reach = max((cut.reach or 0 for cut in cuts), default=0)
    around = _Around(file, size, begin, end, 8 * reach + 16, more)
    spans = []
    for cut in cuts:
        for start, stop, text in _own(around, cut):
            digest = None if cut.digest is None else hash_text(text)
            if digest == cut.digest:
                spans.append({"ord": cut.ord, "start": start, "end": stop, "text": text, "segment_hash": digest})
    return {"n_chars": around.last - around.first, "valid": around.valid(), "spans": spans}


def file_ranges(spark: SparkSession, path, glob: str | None = None, size: int = RANGE) -> DataFrame:
    """``path, length, n, begin, end``: the ranges of the files at ``path``; an empty file has one. No content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length")
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))
    cut = files.select("path", "length", F.posexplode(begins).alias("n", "begin"))
    return cut.select("path", "length", F.col("n").cast("bigint").alias("n"), "begin", F.least(F.col("begin") + size, F.col("length")).alias("end"))


def _by_ranges(ranges: DataFrame, cuts: list[_Cut], opener: Callable[[str], BinaryIO]) -> DataFrame:
    schema = pa.schema({"path": pa.string(), "n": pa.int64(), "n_chars": pa.int64(), "valid": pa.bool_(), "spans": pa.list_(pa.struct({"ord": pa.int32(), "start": pa.int32(), "end": pa.int32(), "text": pa.string(), "segment_hash": pa.string()}))})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opener(row["path"]) as file:
                    spans = range_spans(file, row["length"], row["begin"], row["end"], cuts)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "n": row["n"], **spans}], schema)

    tasks = max(1, min(ranges.count(), TASKS))
    return ranges.repartition(tasks).mapInArrow(found, _FOUND)


def scan_files(spark: SparkSession, path, rules: list[Rule], channel: str = "tool", tool: str | None = None, glob: str | None = None, size: int = RANGE, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """A row for each match of ``rules`` in the files at ``path``, as ``scan`` finds them in ``text_files``.

    ``path, ord, rule_id, action, reason, replacement, start, end, text,
    segment_hash``; places count characters of the text, "\\r\\n" and "\\r"
    being one "\\n", and are longs. Files that aren't UTF-8 and empty ones have
    no matches but those of nothing. A rule that needs whole files (see above)
    reads those by ``text_files``, where Spark's bound of 2 GB holds. A rule
    that is cut by lines holds a line at a time besides its range, and one that
    crosses lines reads on as long as matches touch one another.

    ``opener`` opens a path for reading in an executor. What ranges hold is
    cut by ``checkpoint()``, as it is used twice, so ``spark.checkpoint.dir``
    has to be set.
    """
    if len({rule.id for rule in rules}) < len(rules):
        raise ValueError("two rules share an id; merge them first")
    fits = lambda rule: rule.target in ("both", channel) and rule.tool in (None, tool)
    usable = [(n, rule) for n, rule in enumerate(rules) if rule.pattern and fits(rule) and (rule.hash_extractor or not rule.hashed)]
    cuts = {n: cut for n, rule in usable if (cut := _cut(n, rule))}
    whole = [rule for n, rule in usable if n not in cuts]
    found = _by_ranges(file_ranges(spark, path, glob, size), list(cuts.values()), opener).checkpoint()

    by_file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n_chars").over(by_file.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.select("path", "n", before.alias("before"), F.min("valid").over(by_file).alias("valid")).where("valid").drop("valid")
    spans = found.select("path", "n", F.explode("spans").alias("s")).join(placed, ["path", "n"]).select("path", "s.ord", (F.col("before") + F.col("s.start")).alias("start"), (F.col("before") + F.col("s.end")).alias("end"), "s.text", "s.segment_hash")
    told = spark.createDataFrame([(n, rule.id, rule.action, rule.reason, rule.replacement) for n, rule in usable], "ord int, rule_id string, action string, reason string, replacement string")
    out = spans.join(F.broadcast(told), "ord").select(*_RESULT)
    if whole:
        numbers = F.create_map(*(F.lit(x) for n, rule in usable if n not in cuts for x in (rule.id, n)))
        rest = matches(scan(text_files(spark, path, glob), whole, channel=channel, tool=None if tool is None else F.lit(tool)), ["path"])
        out = out.unionByName(rest.withColumns({"ord": numbers[F.col("rule_id")], "start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")}).select(*_RESULT))
    return out
