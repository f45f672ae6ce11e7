"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words, words become hashes, and every run of ``GRAM`` words gets
a hash. Of each ``WINDOW`` consecutive run hashes the smallest is kept, on
both sides. Two texts that share a span of ``GRAM + WINDOW - 1`` words share
all the runs in it and so keep the same one: no such span is missed. Kept
hashes are joined; around every hit the whole spans are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, text_or_empty

GRAM, WINDOW = 5, 6
#: Words of a span that counts as contamination.
SPAN = GRAM + WINDOW - 1
#: Rows up to which a table is sent to all executors, and values of eight bytes for those with arrays; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_VALUES = 50_000, 2_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once and not again for each element inside ``body``."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, digits, letters and all that isn't ASCII."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _starts(n: Column, length: int) -> Column:
    """1-based places where a run of ``length`` words starts among ``n``."""
    return F.when(n >= length, F.sequence(F.lit(1), n - F.lit(length - 1))).otherwise(F.array().cast("array<int>"))


def _run_hashes(hashes: Column, length: int) -> Column:
    """A hash for every run of ``length`` words."""
    return F.transform(_starts(F.size(hashes), length), lambda i: F.xxhash64(*(hashes[i + F.lit(k - 1)] for k in range(length))))


def _kept(runs: Column) -> Column:
    """The smallest of every ``WINDOW`` consecutive run hashes, with its 1-based place, the first of equal ones."""
    least = lambda i: F.least(*(runs[i + F.lit(k - 1)] for k in range(WINDOW)))

    def first(smallest: Column, i: Column) -> Column:
        at = F.when(runs[i] == smallest, i + F.lit(1))
        for k in range(1, WINDOW):
            at = at.when(runs[i + F.lit(k)] == smallest, i + F.lit(k + 1))
        return at

    # places, not pairs, are made distinct: pairs would be compared each with each
    return F.transform(F.array_distinct(F.transform(F.transform(_starts(F.size(runs), WINDOW), least), first)), lambda at: F.struct(runs[at - F.lit(1)].alias("hash"), at.alias("at")))


def _word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _fingerprints(found: Column, short: list[int]) -> Column:
    """``array<struct<kind, hash, at>>``: kept hashes have kind 0 and their place, whole runs of a short length that length and no place."""

    def of(hashes: Column) -> Column:
        kept = F.transform(_let(_run_hashes(hashes, GRAM), _kept), lambda x: F.struct(F.lit(0).alias("kind"), x["hash"].alias("hash"), x["at"].alias("at")))
        whole = lambda n: F.transform(F.array_distinct(_run_hashes(hashes, n)), lambda h: F.struct(F.lit(n).alias("kind"), h.alias("hash"), F.lit(0).alias("at")))
        return F.concat(kept, *map(whole, short))

    return _let(_word_hashes(found), of)


def _places(hashes: Column, n_words: Column, hits: Column, short: list[int]) -> Column:
    """``array<struct<start, length>>``: spans of the document that may be a benchmark window, around the places of long hits and where a short item's run is."""

    def long_spans() -> Column:
        around = F.transform(hits["h0"], lambda p: F.sequence(F.greatest(F.lit(1), p - F.lit(SPAN - GRAM)), F.least(p, n_words - F.lit(SPAN - 1))))
        return F.transform(F.array_distinct(F.flatten(around)), lambda s: F.struct(s.alias("start"), F.lit(SPAN).alias("length")))

    def short_spans(n: int) -> Column:
        at = lambda runs: F.filter(_starts(n_words, n), lambda p: F.array_contains(hits[f"h{n}"], runs[p - F.lit(1)]))
        return F.transform(_let(_run_hashes(hashes, n), at), lambda s: F.struct(s.alias("start"), F.lit(n).alias("length")))

    none = F.array().cast("array<struct<start:int,length:int>>")
    first = F.when((n_words >= SPAN) & (F.size(hits["h0"]) > 0), long_spans()).otherwise(none)
    return F.concat(first, *(F.when((n_words >= n) & (F.size(hits[f"h{n}"]) > 0), short_spans(n)).otherwise(none) for n in short))


def _covered(spans: Column) -> Column:
    """Words inside at least one span."""
    start = F.struct(F.lit(1).cast("long").alias("next"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, span: Column) -> Column:
        end = (span["start"] + span["length"]).cast("long")
        return F.struct(F.greatest(acc["next"], end).alias("next"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["next"], span["start"].cast("long")))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    A benchmark item's windows are its runs of ``SPAN`` words; an item with
    fewer words, but any, is one window. A document word inside an occurrence
    of a window is hit. Null and empty texts have no words, on either side. A
    null item id counts as an item called "". Repeated rows each get their
    figures; items that share a window all count. Empty tables are allowed,
    texts of any length are read whole, other columns are left out, whatever
    their names.
    """
    return _judged(docs, benchmark, id_column, text_column).drop("key")


def _judged(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``contamination`` with ``key``, a hash of the text that tells rows with the same id apart."""
    source = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(text_or_empty("text")).alias("words")).where(F.size("words") > 0)
    items = materialize(items, "benchmark")
    short = sorted(n for (n,) in items.select(F.size("words")).where(F.size("words") < SPAN).distinct().collect())

    spread = items.select("item", "words", F.least(F.size("words"), F.lit(SPAN)).alias("length"))
    spread = spread.select("item", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    windows = spread.select("item", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window"))
    windows = materialize(windows.groupBy("window").agg(F.collect_set("item").alias("items")), "windows")

    prints = items.select(F.size("words").alias("n"), F.explode(_fingerprints(F.col("words"), short)).alias("p")).select("n", "p.*")
    # a short item is looked for by its whole run alone, a long one by its kept hashes
    prints = prints.where(((F.col("n") >= SPAN) & (F.col("kind") == 0)) | ((F.col("n") < SPAN) & (F.col("kind") == F.col("n")))).select("kind", "hash").distinct()
    prints = broadcast_if_small(materialize(prints, "prints"), BROADCAST_ROWS)

    exploded = source.select("doc_id", "key", words(F.col("text")).alias("words")).select("doc_id", "key", F.explode(_fingerprints(F.col("words"), short)).alias("p")).select("doc_id", "key", "p.kind", "p.hash", "p.at")
    hit = exploded.join(prints, ["kind", "hash"]).groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("kind") == 0, F.col("at"))).alias("h0"), *(F.collect_set(F.when(F.col("kind") == n, F.col("hash"))).alias(f"h{n}") for n in short))
    hit = materialize(hit, "hits")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    small = broadcast_if_small(hit, BROADCAST_VALUES, sum((F.size(f"h{n}") for n in [0, *short]), F.lit(4)))
    near = source.join(small, same(source, small)).select(hit["doc_id"], hit["key"], "text", F.struct(*(f"h{n}" for n in [0, *short])).alias("hits"))
    near = near.withColumn("words", words(F.col("text")))
    places = _let(_word_hashes(F.col("words")), lambda hashes: _places(hashes, F.size("words"), F.col("hits"), short))
    spans = near.select("doc_id", "key", "words", F.explode(places).alias("span"))
    spans = spans.select("doc_id", "key", "span", F.array_join(F.slice("words", F.col("span.start"), F.col("span.length")), " ").alias("window"))
    found = spans.join(broadcast_if_small(windows, BROADCAST_VALUES, 4 + 2 * F.size("items") + F.octet_length("window") / 8), "window").groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = materialize(found.select("doc_id", "key", _covered(F.col("spans")).alias("n_hit"), "items"), "found")

    counted = source.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    small = broadcast_if_small(found, BROADCAST_VALUES, 4 + 2 * F.size("items"))
    none = F.array().cast("array<string>")
    return counted.join(small, same(counted, small), "left").select(
        counted["doc_id"],
        counted["key"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, but for those whose text is contaminated; see :func:`contamination`.

    Null and empty texts stay, and so does a row that only shares its id with
    a contaminated one; repeated rows stay or go together. An empty table
    stays empty and an empty benchmark removes nothing.
    """
    bad = _judged(docs, benchmark, id_column, text_column).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    bad = broadcast_if_small(materialize(bad, "contaminated"), BROADCAST_ROWS)
    key = F.xxhash64(F.coalesce(docs[text_column], F.lit("")))
    return docs.join(bad, docs[id_column].eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")


CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT r, i, n, item FROM dw JOIN win USING (win, n)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM occ), range(10) AS g(k) WHERE k < n GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
