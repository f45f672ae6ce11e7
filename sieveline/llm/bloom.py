"""Bloom filters over pairs of 64-bit hashes, made by Spark and looked up in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level that lets half the other keys through needs this many bits a key.
_HALF = 1 / math.log(2)
#: Names up to which a list of them is sent to all executors as it is, and the hash functions and bytes of a filter that stands for a longer one.
FEW_NAMES, NAME_HASHES, NAME_BYTES = 50_000, 7, 64 << 20


@dataclass(frozen=True)
class Level:
    words: np.ndarray
    bits: int
    hashes: int


def places(keys: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bits of ``keys`` (rows of two hashes) in a filter, ``hashes`` rows of them; others for each ``level``."""
    with np.errstate(over="ignore"):
        salt = np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (keys ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29)) ^ salt) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(32)
        steps = np.arange(hashes, dtype=np.uint64)[:, None]
        return (z[:, 0] + steps * (z[:, 1] | np.uint64(1))) % np.uint64(bits)


def within(level: Level, depth: int, keys: np.ndarray) -> np.ndarray:
    at = places(keys, depth, level.bits, level.hashes)
    return (level.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(0)


def sized(n: int, hashes: int) -> int:
    """Bits of a filter for ``n`` keys."""
    return max(64, math.ceil(n * hashes * _HALF))


def _words_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of the bits ``at``, and their values."""
    word, of = np.unique(at >> np.uint64(6), return_inverse=True)
    made = np.zeros(len(word), np.uint64)
    np.bitwise_or.at(made, of.reshape(-1), np.uint64(1) << (at & np.uint64(63)).reshape(-1))
    return word, made


def filled(keys: np.ndarray, depth: int, hashes: int) -> Level:
    bits = sized(len(keys), hashes)
    words = np.zeros(-(-bits // 64), np.uint64)
    word, made = _words_of(places(keys, depth, bits, hashes))
    words[word] = made
    return Level(words, bits, hashes)


def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch["h1"].to_numpy(), batch["h2"].to_numpy()], 1).view(np.uint64)


def filter_of(keys: DataFrame, n: int, depth: int, hashes: int) -> Level:
    """A filter over the ``n`` rows of ``keys (h1, h2)``: tasks make words of bits, equal words are merged before and after the shuffle."""
    bits = sized(n, hashes)

    def fill(batches):
        for batch in batches:
            word, made = _words_of(places(hashes_of(batch), depth, bits, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(made.view(np.int64))], names=["word", "bits"])

    made = keys.select("h1", "h2").mapInArrow(fill, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[made["word"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return Level(words, bits, hashes)


def keep_named(df: DataFrame, name: str, names: DataFrame, few: int = FEW_NAMES, most_bytes: int = NAME_BYTES) -> DataFrame:
    """The rows of ``df`` whose long ``name`` is in ``names (name)``, all distinct, and maybe a few others: a join has to follow.

    Nothing is shuffled. Up to ``few`` names are sent to all executors, more
    as a Bloom filter that lets through one other row in 128; of so many that
    the filter would exceed ``most_bytes``, all rows are kept.
    """
    n = names.limit(few + 1).count()
    if n <= few:
        return df.join(F.broadcast(names.select(F.col("name").alias("_wanted"))), F.col(name) == F.col("_wanted"), "left_semi")
    named = _lets_through(df, name, names, most_bytes)
    return df if named is None else df.where(named)


def split_named(df: DataFrame, name: str, names: DataFrame, most_bytes: int = NAME_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df`` whose long ``name`` may be in ``names (name)``, all distinct, and all other rows.

    Only the first need a join, so the others aren't shuffled; ``df`` is read
    for each of the two. Of so many names that their Bloom filter would exceed
    ``most_bytes``, all rows are in the first and there is no second.
    """
    named = _lets_through(df, name, names, most_bytes)
    return (df, None) if named is None else (df.where(named), df.where(~named))


def _lets_through(df: DataFrame, name: str, names: DataFrame, most_bytes: int) -> Column | None:
    """Whether a Bloom filter of ``names`` lets a row through; none if it would exceed ``most_bytes``."""
    n = names.count()
    if sized(n, NAME_HASHES) > 8 * most_bytes:
        return None
    hashed = names.select(F.col("name").alias("h1"), F.xxhash64("name").alias("h2"))
    sent = df.sparkSession.sparkContext.broadcast(filter_of(hashed, n, 0, NAME_HASHES))

    @F.arrow_udf("boolean")
    def wanted(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(within(sent.value, 0, np.stack([h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)], 1).view(np.uint64)))

    return wanted(F.col(name), F.xxhash64(name))
