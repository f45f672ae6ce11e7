"""Verdicts on URLs by a Bloom filter cascade over lists of hosts and paths.

A list holds keys: a host with a path prefix (``example.com/en/``). A URL has
few keys that could be listed: its host's last labels with its path's first
characters, in the shapes that the lists use. All distinct keys of the corpus
are the universe of a cascade. Its first Bloom filter holds the listed keys;
the next one the unlisted keys of the universe that the first lets through; the
next one the listed keys that the second lets through; and so on, until none
is left. The first level that doesn't have a key decides, so every key of the
universe is told rightly, and the pages need no join: the filters take a few
bits a listed key and are sent to all executors. Lists whose filters would
exceed ``FILTER_BYTES`` are joined instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Level, filled, filter_of, hashes_of, sized, within
from .common import broadcast_if_small, materialize, unused

#: Bytes of a cascade that is sent to all executors; larger lists are joined.
FILTER_BYTES = 128 << 20
#: Keys left of a level from which on the last levels are made at once.
LAST_KEYS = 50_000
#: Shapes (labels of the host, characters of the path) of listed keys that are looked for at most; with more, lists are joined by host alone.
SHAPES = 2_000
#: Rows up to which a list of keys is sent to all executors.
BROADCAST_ROWS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty if it has no ``://`` or is null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


# --- the cascade ---------------------------------------------------------------


def listed(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (rows of two hashes) are listed: the first level without a key tells."""
    out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for depth, level in enumerate(levels):
        inside = within(level, depth, keys[open_])
        out[open_] = inside if depth % 2 == 0 else ~inside
        # what an even level lacks isn't listed, what an odd one lacks is
        open_ = open_[inside]
        if not len(open_):
            break
    return out


def _let_through(keys: DataFrame, level: Level, depth: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for batch in batches:
            yield batch.filter(pa.array(within(sent.value, depth, hashes_of(batch))))

    return keys.mapInArrow(test, keys.schema)


def _hashed(keys: DataFrame) -> DataFrame:
    """Two hashes of 64 bits of each key; the second can't be aimed at."""
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.sha2("key", 256)).alias("h2"))


def _last_levels(wanted: np.ndarray, other: np.ndarray, depth: int) -> list[Level]:
    levels = []
    while len(wanted):
        if depth > 500:
            raise ValueError("a listed and an unlisted key have the same hashes")
        levels.append(filled(wanted, depth, 1))
        wanted, other = other[within(levels[-1], depth, other)], wanted
        depth += 1
    return levels


def planned_bytes(n_listed: int, n_keys: int) -> int:
    """Bytes that a cascade takes, about: the first level as :func:`build_cascade` sizes it, and two bits a key for each pair of later levels."""
    return (sized(n_listed, _first_hashes(n_listed, n_keys)) + 8 * n_listed) // 8


def _first_hashes(n_listed: int, n_keys: int) -> int:
    """So that about as many unlisted keys pass the first level as there are listed ones."""
    return max(1, math.ceil(math.log2(max(2, n_keys / max(1, n_listed)))))


def build_cascade(universe: DataFrame, keys: DataFrame, last_keys: int = LAST_KEYS) -> list[Level]:
    """The levels that tell which keys of ``universe (key, h1, h2)``, all distinct, are in ``keys (key)``, all distinct.

    The universe is read once. Of what passes the first level, the listed keys
    are marked by a join; the levels after it work on their rows alone, which
    halve from level to level, and the last ones are made from ``last_keys``
    keys at most at once. Unlisted keys outside the universe may be told
    wrongly, listed ones never are by an even last level.
    """
    keys = materialize(_hashed(keys), "listed")
    n_listed, n_keys = keys.count(), universe.count()
    if not n_listed:
        return []
    levels = [filter_of(keys, n_listed, 0, _first_hashes(n_listed, n_keys))]
    passed = _let_through(universe, levels[0], 0)
    marked = passed.join(broadcast_if_small(keys.select("key", F.lit(True).alias("listed")), BROADCAST_ROWS), "key", "left")
    marked = materialize(marked.withColumn("listed", F.coalesce("listed", F.lit(False))), "passed")
    counts = {bool(r["listed"]): r["count"] for r in marked.groupBy("listed").count().collect()}
    # a level holds those of one kind that the level before let through
    wanted, other = marked.where("not listed"), marked.where("listed")
    n_wanted, n_other, depth = counts.get(False, 0), counts.get(True, 0), 1
    while n_wanted and n_wanted + n_other > last_keys:
        levels.append(filter_of(wanted, n_wanted, depth, 1))
        through = materialize(_let_through(other, levels[-1], depth), "passed")
        wanted, other, n_wanted, n_other, depth = through, wanted, through.count(), n_wanted, depth + 1
        if depth > 500:
            raise ValueError("a listed and an unlisted key have the same hashes")
    if n_wanted:
        both = [np.stack([t["h1"].to_numpy(), t["h2"].to_numpy()], 1).view(np.uint64) for t in (x.select("h1", "h2").toArrow() for x in (wanted, other))]
        levels += _last_levels(*both, depth)
    return levels


# --- verdicts --------------------------------------------------------------------


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Labels and path lengths of the rules' keys, the longest first."""
    labels = F.size(F.split("host", "\\."))
    rows = rules.select(labels.alias("labels"), F.length("path").alias("length")).distinct().limit(SHAPES + 1).collect()
    if len(rows) > SHAPES:
        raise ValueError(f"rules of more than {SHAPES} shapes (labels of the host, length of the path); cut their paths at fewer lengths")
    return sorted(((r["labels"], r["length"]) for r in rows), reverse=True)


def _keys(shapes: list[tuple[int, int]], host: Column, path: Column) -> Column:
    """A URL's keys of the given shapes, the longest host and path first."""
    given = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(length).alias("length")) for n, length in shapes))
    dots, length = F.length(host) - F.length(F.replace(host, F.lit("."))), F.length(path)
    fit = F.filter(given, lambda s: (s["labels"] <= dots + 1) & (s["length"] <= length))
    return F.transform(fit, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["length"])))


def _told(levels: dict[str, list[Level]], spark):
    """A function of hashes of keys that gives the place of the first listed key and its verdict."""
    sent = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("struct<place: int, verdict: string>")
    def first_listed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        sizes = h1.value_lengths().to_numpy(zero_copy_only=False)
        keys = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in (h1, h2)], 1).view(np.uint64)
        starts = np.cumsum(sizes) - sizes
        place, verdict = np.full(len(sizes), -1, np.int32), np.full(len(sizes), None, object)
        row = np.repeat(np.arange(len(sizes)), sizes)
        for name, of in sent.value.items():
            hits = np.flatnonzero(listed(of, keys))[::-1]  # the first of a row is set last
            first = np.full(len(sizes), -1, np.int64)
            first[row[hits]] = hits - starts[row[hits]]
            better = (first >= 0) & ((place < 0) | (first < place))
            place[better], verdict[better] = first[better], name
        return pa.StructArray.from_arrays([pa.array(place, pa.int32(), mask=place < 0), pa.array(verdict, pa.string())], ["place", "verdict"])

    return first_listed


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_column: str = "url", filter_bytes: int = FILTER_BYTES, last_keys: int = LAST_KEYS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` of each row.

    ``rules`` has ``host`` (not empty; upper case letters A-Z count as lower
    case), ``path`` (empty or beginning with a slash) and ``verdict``. A rule
    fits its host and all subdomains if the URL's path starts with the rule's.
    The longest fitting rule wins, by its host and then by its path; ``rule``
    is its host and path. Of rules with the same key ``block`` wins, else the
    verdict first in order. A page without one has a null ``rule`` and the
    ``default`` verdict: the cascade tells exactly that none of its keys is
    listed. Null URLs and those without ``://`` have an empty host and path;
    very long ones are read whole, in time linear to their length. Repeated
    rows stay, an empty table stays empty and no rules judge all pages by the
    default. Columns of ``pages`` named like one of the four are replaced.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_column))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = rules.select(F.translate("host", upper, lower).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    named = materialize(rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min_by(F.struct("host", "path", "verdict"), F.struct(F.col("verdict") != "block", "verdict")).alias("r")).select("key", "r.*"), "rules")
    h, p, keys, found = unused(pages, "_host", "_path", "_keys", "_found")
    shapes = _shapes(named)
    located = pages.withColumns({h: host, p: path})
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not shapes:
        return located.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    located = located.withColumn(keys, _keys(shapes, F.col(h), F.col(p)))
    parts = {r["verdict"]: r["count"] for r in named.groupBy("verdict").count().collect()}
    universe = materialize(_hashed(located.select(F.explode(keys).alias("key")).distinct()), "universe")
    n_keys = universe.count()
    if sum(planned_bytes(n, n_keys) for n in parts.values()) <= filter_bytes:
        levels = {v: build_cascade(universe, named.where(F.col("verdict") == v).select("key"), last_keys) for v in sorted(parts)}
        first = _told(levels, spark)
        hashes = (F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.sha2(k, 256))))
        told = located.withColumn(found, first(*hashes))
        rule, verdict = F.get(F.col(keys), F.col(found)["place"]), F.col(found)["verdict"]
    else:
        # lists too large to be sent: each distinct host and path is joined once
        once = located.groupBy(h, p).agg(F.first(keys).alias(keys))
        hits = once.select(h, p, F.posexplode(keys).alias("at", "key")).join(named.select("key", F.col("verdict").alias("v")), "key")
        hits = materialize(hits.groupBy(h, p).agg(F.min_by(F.struct("key", "v"), "at").alias(found)), "hits")
        told = located.join(hits, [h, p], "left")
        rule, verdict = F.col(found)["key"], F.col(found)["v"]
    return told.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))


#: The query's rules: host, path and verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judge_pages(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page under ``RULES``."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


JUDGE_SQL = r"""
WITH rules (rule_host, rule_path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
located AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
fitting AS (
  SELECT n, arg_max({'rule': rule_host || rule_path, 'action': action}, length(rule_host) * 100000 + length(rule_path)) AS best
  FROM located JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM located LEFT JOIN fitting USING (n)
"""
