"""Token ids on disk: one concatenated id array with Elias-Fano document boundaries.

A file set is a folder that Spark's Parquet writer commits as a whole. Each of
its rows is a block of consecutive documents in ascending id order:

``part, block``     place of the block: partition of the writer, number in it
``before``          ids in the part before this block
``n_docs, n_ids``   documents and ids in the block
``ids``             the ids, little-endian, 2 bytes each if the vocabulary allows, else 4
``width``           that number of bytes
``ends``            Elias-Fano code of the documents' ends within the block
``doc_ids``         Elias-Fano code of the document ids less ``first_id``
``first_id``, ``last_id``  smallest and largest document id of the block
``n_null``          documents without an id; they come first

A boundary costs about ``2 + log2(n_ids / n_docs)`` bits in place of 64.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, shared_dir, text_or_empty
from .tokens import encoder

#: Ones between two entries of the select table.
SAMPLE = 64
BLOCK_IDS = 1 << 17
_HEAD = struct.Struct("<QQBQ")  # count, universe, low bits, bytes of the high part


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``universe``, with ``select``.

    Low bits are packed; high parts stand as a unary bit vector. The select
    table holds the place of every ``SAMPLE``-th one, so ``select(i)`` reads a
    bounded stretch of that vector.
    """

    def __init__(self, count: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.count, self.universe, self.low_bits = count, universe, low_bits
        self.low, self.high, self.sampled = low, high, sampled

    @classmethod
    def encode(cls, values, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((universe >> low_bits) + n + 1, np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, universe, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.count, self.universe, self.low_bits, len(self.high)) + self.high.tobytes() + self.low.tobytes() + self.sampled.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, universe, low_bits, n_high = _HEAD.unpack_from(data)
        raw, n_low = np.frombuffer(data, np.uint8, offset=_HEAD.size), -(-count * low_bits // 8)
        return cls(count, universe, low_bits, raw[n_high : n_high + n_low], raw[:n_high], np.frombuffer(raw[n_high + n_low :].tobytes(), "<u4"))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits) * weights).sum(1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        return ((places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.count)

    @cached_property
    def _raw(self) -> tuple[bytes, bytes]:
        return self.high.tobytes(), self.low.tobytes()

    def select(self, i: int) -> int:
        """The ``i``-th value, read from the nearest sampled place on."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        (high, low), at, wanted = self._raw, int(self.sampled[i // SAMPLE]), i % SAMPLE
        byte = at // 8 + 8
        bits = int.from_bytes(high[byte - 8 : byte], "little") >> at % 8
        while (ones := bits.bit_count()) <= wanted:
            wanted, at, byte = wanted - ones, 8 * byte, byte + 32
            bits = int.from_bytes(high[byte - 32 : byte], "little")
        for _ in range(wanted):
            bits &= bits - 1
        place, first = at + (bits & -bits).bit_length() - 1, i * self.low_bits
        rest = int.from_bytes(low[first // 8 : -(-(first + self.low_bits) // 8)], "little") >> first % 8
        return ((place - i) << self.low_bits) | (rest & ((1 << self.low_bits) - 1))


class Block:
    """One block as read back; places are found by the select structures, no table of 64-bit offsets is made."""

    def __init__(self, n_docs: int, n_ids: int, ids: bytes, width: int, ends: bytes, doc_ids: bytes, first_id: int, n_null: int):
        self.n_docs, self.n_ids, self.n_null, self.first_id = n_docs, n_ids, n_null, first_id
        self._ids = np.frombuffer(ids, f"<u{width}")
        self.ends, self.known = EliasFano.from_bytes(ends), EliasFano.from_bytes(doc_ids)

    def doc_id(self, i: int) -> int | None:
        """The id of the ``i``-th document."""
        return None if i < self.n_null else self.first_id + self.known.select(i - self.n_null)

    def places(self, doc_id: int | None) -> range:
        """Places of the documents with this id, by binary search."""
        if doc_id is None:
            return range(self.n_null)
        known = range(self.n_null, self.n_docs)
        return range(bisect_left(known, doc_id, key=self.doc_id) + self.n_null, bisect_right(known, doc_id, key=self.doc_id) + self.n_null)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.offsets(i)
        return self._ids[start:end]

    def documents(self, places=None):
        """(doc_id, start, ids as unsigned 32-bit) of the documents at ``places``, or of all."""
        last, end = -1, 0
        for i in range(self.n_docs) if places is None else places:
            start = end if i == last + 1 else self.ends.select(i - 1)
            last, end = i, self.ends.select(i)
            yield self.doc_id(i), start, self._ids[start:end].astype("<u4")


_BLOCKS = "part int, block int, before bigint, n_docs bigint, n_ids bigint, width int, first_id bigint, last_id bigint, n_null bigint, ids binary, ends binary, doc_ids binary"
_BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_null", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("doc_ids", pa.binary())])


def encoded(docs: DataFrame, tokenizer: str, boundary: str = "drop", end_id: int = 1, width: int = 2, special: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: its ids and then ``end_id``, little-endian in ``width`` bytes each."""
    schema, kind, end = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), f"<u{width}", end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(tokenizer, boundary, special).encode
        for batch in batches:
            made = []
            for text in batch.column(1):
                wide = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if width < 4 and wide.max() >> (8 * width):
                    raise ValueError(f"an id takes more than {width} bytes")
                made.append(wide.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=schema)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, boundary: str = "drop", end_id: int = 1, width: int = 2, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text", special: bool = True) -> None:
    """Encode every document and write the file set to ``path``.

    Each document is its ids and then ``end_id``. ``width`` is 2 for
    vocabularies up to 65,536, else 4. Only ids are sorted by document, no
    texts; rows of one id are in order of a hash of their ids, so repeated
    rows have a defined place and a hot id, or rows without one, can be spread
    over tasks. A null text is an empty one. Rows with a null id come first. A
    text of any length is encoded whole; a block is as long as its longest
    document at least. An empty table gives no blocks; other columns are left
    out.
    """

    def blocks(batches):
        part = TaskContext.get().partitionId()
        names, ends, held, n_ids, n_block, before = [], [], [], 0, 0, 0

        def block():
            n_null = names.count(None)
            known = np.asarray(names[n_null:] or [0], np.int64)
            coded = EliasFano.encode(known[: len(names) - n_null] - known[0], int(known[-1] - known[0]))
            row = (part, n_block, before, len(names), n_ids, width, int(known[0]), int(known[-1]), n_null, b"".join(held), EliasFano.encode(ends, n_ids).to_bytes(), coded.to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append(ids.as_py())
                n_ids += len(held[-1]) // width
                names.append(doc_id)
                ends.append(n_ids)
                if n_ids >= BLOCK_IDS:
                    yield block()
                    n_block, before = n_block + 1, before + n_ids
                    names, ends, held, n_ids = [], [], [], 0
        if names:
            yield block()

    made = encoded(docs, tokenizer, boundary, end_id, width, special, id_column, text_column)
    # written first: the range partitioner looks at its input twice
    made = materialize(made.select("doc_id", F.xxhash64("ids").alias("key"), F.monotonically_increasing_id().alias("row"), "ids"), "encoded", "zstd")
    order = ["doc_id", "key", "row"]
    placed = made.repartitionByRange(partitions, *order) if partitions else made.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(path)


def _read(spark: SparkSession, path: str, stored: DataFrame, with_ids: bool, wanted) -> DataFrame:
    """Documents of the blocks ``stored``: those that ``wanted(block)`` gives the places of, or all."""
    totals = spark.read.schema(_BLOCKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("total"))
    bases = totals.selectExpr("part", "sum(total) over (order by part) - total AS base")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                block = Block(*(one[x] for x in ("n_docs", "n_ids", "ids", "width", "ends", "doc_ids", "first_id", "n_null")))
                found = block.documents(wanted(block) if wanted else None)
                rows = [(doc_id, one["base"] + one["before"] + start, len(ids), zlib.crc32(ids), *([ids.tobytes()] if with_ids else [])) for doc_id, start, ids in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return stored.join(broadcast_if_small(bases, 100_000), "part").drop("part", "block", "last_id").mapInArrow(documents, schema)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a file set: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before it. Only the totals of
    the parts (a row for each partition of the writer) are summed up in one
    place. An empty file set gives an empty table.
    """
    return _read(spark, path, spark.read.schema(_BLOCKS).parquet(path), with_ids, None)


def look_up(spark: SparkSession, path: str, doc_ids: list[int], with_ids: bool = True) -> DataFrame:
    """``read_token_ids`` for some documents: only blocks whose range of ids holds one of them are read."""
    ids = sorted(set(doc_ids))
    stored = spark.read.schema(_BLOCKS).parquet(path)
    near = reduce(or_, ((F.col("first_id") <= i) & (F.col("last_id") >= i) for i in ids), F.lit(False))
    return _read(spark, path, stored.where(near), with_ids, lambda block: [place for i in ids for place in block.places(i)])


def token_ids(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a new file set in the shared folder and read it back."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, tokenizer, **options)
    return read_token_ids(docs.sparkSession, path)
