"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; a place where its upper bits are
below a threshold is a cut. Cuts depend on the bytes just before them alone, so an
insertion moves the chunks behind it but doesn't change them, and a passage
that two documents share is cut alike in both. Chunks are compared by a
64-bit digest. The document with the smallest id that holds a chunk keeps it.

A single chunk may be a few words that recur by chance. A repeat is therefore
a run of chunks, one after the other, that all occur elsewhere, of at least
``MIN_WORDS`` words together; two digests that agree by chance make none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as xxh3

from .bloom import split_named
from .common import broadcast_if_small, materialize, text_or_empty

#: A cut every so many bytes on average.
EVERY = 30
#: Bytes that a cut depends on, and bytes between a cut and the hash's cut before it, at least.
ROLL, MIN_BYTES = 16, 4
#: A passage of over 50 words holds a run of whole chunks of this many words, unless it has no cut in a stretch far above the average.
MIN_WORDS = 14
#: A document that first held fewer words of a removed passage than this agrees by chance, as one short chunk does.
MIN_HELD = 3
#: Values of eight bytes up to which the table of repeats is sent to all executors; a larger one is shuffled.
BROADCAST_VALUES = 2_000_000


def _gears(seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = _gears()


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``; the last one is its length.

    The hash at a byte is the sum of the last ``ROLL`` bytes' gears, each
    shifted by its age, made for all places at once by doubling the span.
    Where two cuts are nearer than ``MIN_BYTES`` the second is left out if
    the place before it is cut itself, whatever came before that.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < ROLL:
        older = np.zeros_like(h)
        older[span:] = h[:-span] if len(h) > span else 0
        h = h + (older << np.uint32(span))
        span *= 2
    # the upper bits that the last ROLL bytes alone decide
    at = np.flatnonzero((h & np.uint32((1 << ROLL) - 1)) < (1 << ROLL) // EVERY) + 1
    inside = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)
    for _ in range(3):  # a cut inside a character moves behind it
        at = at + inside[at]
    if len(at) > 1:
        at = at[np.r_[True, np.diff(at) >= MIN_BYTES]]
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


_CHUNKS = "doc_id bigint, key bigint, place bigint, size bigint, digest bigint"


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of ``docs (doc_id, key, text as bytes)``.

    A null id becomes zero, and its ``place`` is turned into a negative number
    by flipping all bits. ``place`` is its number and its first byte, ``size`` its bytes and the
    words that end in it, 32 bits each. ``size`` is negative if further up in
    the text there is a chunk like it.
    """
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _CHUNKS.split(", ")])

    def of(data: bytes):
        end = cuts(data)
        start = np.append(0, end[:-1])
        digests = np.fromiter((xxh3(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(end)).view(np.int64)
        space = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
        ends_word = np.append(space[1:], True) & ~space
        words = np.diff(np.append(0, np.cumsum(ends_word)[end - 1]))
        sign = np.full(len(end), -1)
        sign[np.unique(digests, return_index=True)[1]] = 1
        return (np.arange(len(end)) << 32) | start, sign * (((end - start) << 32) | words), digests

    def run(batches):
        for batch in batches:
            parts, ids, keys, n = [], [], [], 0
            for doc_id, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if data := value.as_py():
                    place, size, digest = of(data)
                    parts.append((~place if doc_id is None else place, size, digest))
                    ids.append(np.full(len(place), doc_id or 0, np.int64))
                    keys.append(np.full(len(place), key, np.int64))
                    n += len(ids[-1])
                if n > 200_000:
                    yield table(ids, keys, parts)
                    parts, ids, keys, n = [], [], [], 0
            if parts:
                yield table(ids, keys, parts)

    def table(ids, keys, parts):
        columns = [np.concatenate(ids), np.concatenate(keys), *(np.concatenate(c) for c in zip(*parts, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, _CHUNKS)


_RUNS = "doc_id bigint, key bigint, removed array<struct<start:bigint,end:bigint,words:bigint>>, shared array<struct<start:bigint,end:bigint,words:bigint>>, linked array<bigint>"


def _runs(chosen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, among the ``chosen`` ones, of each run of chunks whose numbers ``n`` follow one another."""
    if not len(chosen):
        return chosen, chosen
    apart = np.flatnonzero(np.diff(n[chosen]) != 1)
    return np.append(0, apart + 1), np.append(apart, len(chosen) - 1)


def _repeated_runs(parts: dict, min_words: int) -> tuple[list, list, list]:
    """Removed and shared runs of at least ``min_words`` words of a document's repeated chunks, and the first holders of the removed ones.

    Holders of fewer than ``MIN_HELD`` words of a run are left out where
    another holds more.
    """
    low = (1 << 32) - 1
    n, start = parts["place"] >> 32, parts["place"] & low
    end, words = start + (parts["size"] >> 32), parts["size"] & low
    found, holders = [], []
    for chosen in (np.flatnonzero(parts["repeated"]), np.arange(len(n))):
        runs = []
        for a, b in zip(*(x.tolist() for x in _runs(chosen, n)), strict=True):
            of = chosen[a : b + 1]
            total = int(words[of].sum())
            if total < min_words:
                continue
            runs.append({"start": int(start[of[0]]), "end": int(end[of[-1]]), "words": total})
            if not found:
                of = of[~parts["nobody"][of]]
                others, which = np.unique(parts["other"][of], return_inverse=True)
                large = np.bincount(which, words[of], len(others)) >= MIN_HELD
                holders += (others[large] if large.any() else others).tolist()
        found.append(runs)
    return *found, sorted(set(holders))


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.encode(text_or_empty(text_column), "UTF-8").alias("bytes")).withColumn("key", F.xxhash64("bytes"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with repeated passages: ``doc_id, key, removed, shared, linked``.

    ``removed``: byte spans that a document with a smaller id, or this one
    further up, holds already. ``shared``: all spans that also occur
    elsewhere, first occurrences included. ``linked``: ids of all first
    holders of chunks in the removed spans, but for chance ones (``MIN_HELD``). ``key`` is a hash of the text that tells
    rows with the same id apart; such rows are one document. Rows without an
    id come last. Null and empty texts have no chunks.
    """
    made = materialize(chunks(_source(docs, id_column, text_column).select("doc_id", "key", "bytes")), "chunks")
    holder = F.struct((F.col("place") < 0).alias("none"), "doc_id")
    several = made.groupBy("digest").agg(F.min(holder).alias("other"), F.max(holder).alias("last"), F.min("size").alias("size")).where("other < last OR size < 0").select("digest", "other")
    # written first, so that the join reads two plain shuffles and a hot chunk's rows can be split
    hit = made.join(materialize(several, "several"), "digest")
    none = F.col("place") < 0
    place = F.when(none, F.bitwise_not("place")).otherwise(F.col("place"))
    hit = hit.select("doc_id", "key", none.alias("none"), place.alias("place"), F.abs("size").alias("size"), ((F.col("size") < 0) | (holder > F.col("other"))).alias("repeated"), F.col("other.none").alias("nobody"), F.col("other.doc_id").alias("other"))
    by_text = hit.groupBy("doc_id", "key", "none").agg(F.array_sort(F.collect_set(F.struct("place", "size", "repeated", "nobody", "other"))).alias("parts"))

    def runs(batches):
        for batch in batches:
            lists = batch.column("parts")
            flat = {name: lists.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("place", "size", "repeated", "nobody", "other")}
            ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
            rows = []
            for at in range(batch.num_rows):
                removed, shared, linked = _repeated_runs({name: x[ends[at] : ends[at + 1]] for name, x in flat.items()}, min_words)
                if shared:
                    rows.append({"doc_id": None if batch.column("none")[at].as_py() else batch.column("doc_id")[at].as_py(), "key": batch.column("key")[at].as_py(), "removed": removed, "shared": shared, "linked": linked})
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("removed", span), ("shared", span), ("linked", pa.list_(pa.int64()))]))

    return by_text.mapInArrow(runs, _RUNS)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, n_removed_words, n_shared_words, removed, linked`` of every row.

    ``text`` is the text without the passages that are held elsewhere already
    (a null text stays null, an empty one empty), ``removed`` their spans in
    bytes of the UTF-8 text, ``start:end`` joined by commas. Of equal passages
    the one with the smallest document id stays, in one document the first;
    repeated rows of one id and text are one document and each get its result.
    Rows without an id count as one document that comes last, so they aren't
    repeats of one another. Texts of any length are cut whole; the chunks of
    one document meet in one row. An empty table gives an empty result; other
    columns are left out, whatever their names.
    """
    found = materialize(repeats(docs, min_words, id_column, text_column), "repeats")
    total = lambda runs: F.coalesce(F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["words"]), F.lit(0).cast("bigint"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "removed", "linked", total(F.col("shared")).alias("n_shared_words"))
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).withColumn("key", F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    part = lambda start, end: F.decode(F.substring("bytes", (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
    behind = lambda i: F.coalesce(F.get("removed", i - 1)["end"], F.lit(0).cast("bigint"))
    pieces = F.transform("removed", lambda r, i: part(behind(i), r["start"]))
    text = F.concat(F.array_join(pieces, ""), part(behind(F.size("removed")), F.octet_length("bytes")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    small = broadcast_if_small(found, BROADCAST_VALUES, 6 + 4 * F.size("removed") + F.size("linked"))
    if small is found:
        # too large to be sent: the texts without a repeat, by a Bloom filter, stay where they are
        maybe, others = split_named(source.withColumn("name", F.xxhash64("doc_id", "key")), "name", found.select(F.xxhash64("_id", "_key").alias("name")).distinct())
        joined = maybe.join(found, same, "left")
        joined = joined if others is None else joined.unionByName(others, allowMissingColumns=True)
    else:
        joined = source.join(small, same, "left")
    joined = joined.withColumn("bytes", F.encode("text", "UTF-8"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    cut = F.when(F.size("removed") > 0, text).otherwise(F.col("text"))
    return joined.select("doc_id", cut.alias("text"), total(F.col("removed")).alias("n_removed_words"), F.coalesce("n_shared_words", F.lit(0)).cast("bigint").alias("n_shared_words"), F.coalesce(spans, F.lit("")).alias("removed"), F.coalesce("linked", F.array().cast("array<bigint>")).alias("linked"))
