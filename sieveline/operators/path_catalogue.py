"""Path rules by the thousands.

``scan_paths`` tests each glob on each path. Here globs are put in tries by the
text that they begin with, or by the one that they end with if that is longer,
and in an Aho-Corasick automaton by an inner text if they have neither; a path
is walked once through each, and only globs that it meets there are tested.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import Rule
from .paths import normalize
from .scan import NONE, once

#: What isn't a glob's plain text. A "[" without its "]" is plain, but taken for a class here it only makes the plain text shorter.
_SPECIAL = re.compile(r"\*|\?|\[!?\]?[^\]]*\]?")


class Trie:
    """Texts with values; tells the values of all texts that a text begins with."""

    def __init__(self):
        self.root: tuple = ({}, [])
        self.size = 0

    def add(self, text: str, value: int) -> None:
        node = self.root
        for c in text:
            node = node[0].setdefault(c, ({}, []))
        node[1].append(value)
        self.size += 1

    def along(self, text) -> Iterator[int]:
        node = self.root
        yield from node[1]
        for c in text:
            node = node[0].get(c)
            if node is None:
                return
            yield from node[1]


@dataclass
class Globs:
    """Globs by their numbers; ``fitting`` tells those that fit a text as a whole."""

    globs: dict[int, str]
    begins: Trie = field(default_factory=Trie)
    ends: Trie = field(default_factory=Trie)
    exact: dict = field(default_factory=dict)
    inner: ahocorasick.Automaton | None = None
    tested: int = 0

    def __post_init__(self):
        self.compiled: dict = {}
        by_inner: dict = {}
        for n, glob in self.globs.items():
            plain = _SPECIAL.split(glob)
            if len(plain) == 1:
                self.exact.setdefault(glob, []).append(n)
            elif plain[0] or plain[-1]:
                first = len(plain[0]) >= len(plain[-1])
                (self.begins if first else self.ends).add(plain[0] if first else plain[-1][::-1], n)
            elif longest := max(plain, key=len):
                by_inner.setdefault(longest, []).append(n)
            else:
                self.begins.add("", n)
        if by_inner:
            self.inner = ahocorasick.Automaton()
            for text, numbers in by_inner.items():
                self.inner.add_word(text, numbers)
            self.inner.make_automaton()

    def _fits(self, n: int, text: str) -> bool:
        self.tested += 1
        if n not in self.compiled:
            self.compiled[n] = re.compile(fnmatch.translate(self.globs[n]))
        return self.compiled[n].match(text) is not None

    def fitting(self, text: str) -> set[int]:
        met = {*self.begins.along(text), *self.ends.along(reversed(text))}
        for _, numbers in self.inner.iter(text) if self.inner else ():
            met.update(numbers)
        return {n for n in met if self._fits(n, text)} | {*self.exact.get(text, ())}


#: Tries that a worker has made, by their catalogue's digest.
_made: dict[str, Globs] = {}


def _globs(name: str, globs: dict[int, str]) -> Globs:
    if name not in _made:
        while len(_made) >= 4:
            del _made[next(iter(_made))]
        _made[name] = Globs(globs)
    return _made[name]


def forms(normal: str, inside: str) -> list[str]:
    """What globs are tested on: a normalized path, the same relative to the project, and its last part."""
    out = [normal, normal.rsplit("/", 1)[-1]]
    if normal.startswith(inside):
        out.append(normal[len(inside) :])
    elif normal == (inside[:-1] or "/"):
        out.append(".")
    return out


def scan_path_catalogue(df: DataFrame, rules: list[Rule], paths_column: str, channel: Column | str = "tool", tool: Column | str | None = None, out: str = "path_matches", project_dir: str | None = None, home: str | None = None) -> DataFrame:
    """What ``scan_paths`` gives, for any number of rules: ``df`` with an array of the matches by path, then by rule.

    The plan doesn't grow with the rules, which are sent to all executors (some
    hundred bytes each) and kept there as tries. A glob without any plain text
    is tested on every path. A null array has no matches, nor has a null path.
    """
    project_dir, home = project_dir or str(Path.cwd()), home or str(Path.home())
    usable = [(n, rule, home + rule.path_pattern[1:] if rule.path_pattern.startswith("~/") else rule.path_pattern) for n, rule in enumerate(rules) if rule.path_pattern]
    name = hashlib.sha256(repr(usable).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(usable)
    inside = project_dir.rstrip("/") + "/"

    @F.arrow_udf(NONE)
    def found(paths: pa.Array, normals: pa.Array, channels: pa.Array, tools: pa.Array) -> pa.Array:
        globs = _globs(name, {n: glob for n, _, glob in sent.value})
        place = {n: i for i, (n, _, _) in enumerate(sent.value)}
        offsets, at, texts = [0], [], []
        for given, normal, channel, tool in zip(paths.to_pylist(), normals.to_pylist(), channels.to_pylist(), tools.to_pylist(), strict=True):
            for path, form in zip(given or (), normal or (), strict=True):
                met = set().union(*map(globs.fitting, forms(form, inside))) if form is not None else ()
                for i in sorted(place[n] for n in met):
                    rule = sent.value[i][1]
                    if rule.target in ("both", channel) and rule.tool in (None, tool):
                        at.append(i)
                        texts.append(path)
            offsets.append(len(at))
        rows, ids = sent.value, pa.array(at, pa.int32())
        of = lambda value: pa.array([value(rule) for _, rule, _ in rows], pa.string()).take(ids)
        columns = {
            "ord": pa.array([rows[i][0] for i in at], pa.int32()),
            "rule_id": of(lambda r: r.id),
            "action": of(lambda r: r.action),
            "reason": of(lambda r: r.reason),
            "replacement": of(lambda r: r.replacement),
            "start": pa.array([0] * len(at), pa.int32()),
            "end": pa.array(map(len, texts), pa.int32()),
            "text": pa.array(texts, pa.string()),
            "segment_hash": pa.nulls(len(at), pa.string()),
        }
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    as_column = lambda value: F.lit(value).cast("string") if value is None or isinstance(value, str) else value
    given = F.col(paths_column)
    normals = F.transform(given, lambda path: normalize(path, project_dir, home))
    return once(df, out, found(given, normals, as_column(channel), as_column(tool)))
