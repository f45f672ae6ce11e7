"""Best-fit packing of tokenized documents into fixed-length sequences.

Every input partition packs its own documents in one pass: bounded-space
online best fit. A fixed number of bins is open at a time. Bins are keyed by
their free space; a bitset of the free spaces in use answers "least free space
that still holds this piece" with two integer operations. When too many bins
are open, the fullest one closes. What is still open at the end of a partition
goes, piece by piece, to a merge round that packs the left-overs of several
partitions together, and so on until one group is left. A round's group holds
at most ``MERGE`` times ``open_bins`` bins, whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .tokens import encoder

#: Partitions whose left-overs meet in one group of a merge round.
MERGE = 16


class BestFit:
    """Open bins of one packer. ``add`` and ``flush`` yield finished bins: lists of (length, piece)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self._levels = 0  # bit f is set if a bin with f free places is open
        self._bins: dict[int, deque] = {}
        self._count = 0

    def _take(self, free: int) -> list:
        """The oldest bin with ``free`` places."""
        queue = self._bins[free]
        taken = queue.popleft()
        self._count -= 1
        if not queue:
            del self._bins[free]
            self._levels &= ~(1 << free)
        return taken

    def _put(self, free: int, pieces: list) -> None:
        self._bins.setdefault(free, deque()).append(pieces)
        self._levels |= 1 << free
        self._count += 1

    def add(self, length: int, piece) -> list[list]:
        fitting = self._levels >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            pieces = self._take(free)
        else:
            free, pieces = self.capacity, []
        pieces.append((length, piece))
        if free == length:
            return [pieces]
        self._put(free - length, pieces)
        if self._count <= self.open_bins:
            return []
        fullest = (self._levels & -self._levels).bit_length() - 1
        return [self._take(fullest)]

    def flush(self) -> list[tuple[int, list]]:
        """(free, pieces) of every bin that is still open, fullest first."""
        return [(free, pieces) for free in sorted(self._bins) for pieces in self._bins[free]]


class _Numbered:
    """Rows of finished bins: each gets a sequence number, each piece its offset."""

    def __init__(self, round_: int, group: int, slack: int, last: bool):
        self.base = (round_ << 56) | (group << 28)
        self.slack, self.last, self.n, self.rows = slack, last, 0, []

    def close(self, pieces: list, closed: bool = True) -> None:
        offset = 0
        for length, piece in pieces:
            self.rows.append((*piece, length, self.base + self.n, offset, closed))
            offset += length
        self.n += 1

    def finish(self, packer: BestFit) -> None:
        """Bins that are as good as full close; the pieces of the others are packed again, but in the last round."""
        for free, pieces in packer.flush():
            self.close(pieces, self.last or free <= self.slack)


#: The group that left a piece, as in its sequence's number.
_GROUP = "shiftright(sequence_id, 28) & ((1L << 28) - 1)"


def pack(docs: DataFrame, tokenizer: str, boundary: str = "prefix", end_id: int = 0, capacity: int = 2048, open_bins: int = 256, slack: float = 0.005, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, special: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizers JSON file, ``boundary`` how it
    treats spaces and ``special`` whether special tokens' strings in a text
    are their ids (see ``tokens``). A document is its ids and then ``end_id``.
    Only a document longer than ``capacity`` is cut: into pieces of exactly
    ``capacity`` ids, of which the first may be shorter.

    Result, a row for each piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, ``with_ids``, ``ids`` (little-endian unsigned
    32-bit). A null or empty text is a document of one id. Repeated rows are
    packed as often as they occur; a null id stays null. An empty table gives
    an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, piece int, start bigint, ids_crc32 bigint, " + "ids binary, " * with_ids + "length bigint, sequence_id bigint, offset bigint, closed boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])
    end = end_id.to_bytes(4, "little")
    spare = int(capacity * slack)

    def first(batches):
        packer, out = BestFit(capacity, open_bins), _Numbered(0, TaskContext.get().partitionId(), spare, False)
        encode = encoder(tokenizer, boundary, special).encode
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                head = total % capacity or capacity
                for n, start in enumerate([0, *range(head, total, capacity)]):
                    own = ids[4 * start : 4 * (start + (capacity if n else head))]
                    piece = (doc_id, n, start, zlib.crc32(own), *([own] if with_ids else []))
                    length = len(own) // 4
                    if length == capacity:
                        out.close([(length, piece)])
                    else:
                        for pieces in packer.add(length, piece):
                            out.close(pieces)
            yield from rows(out)
        out.finish(packer)
        yield from rows(out)

    def rows(out):
        if out.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out.rows, strict=True), arrow, strict=True)], schema=arrow)
            out.rows = []

    def again(round_, last):
        def repack(batches):
            """Pieces come by group, so one packer is open at a time; ids pass through as they are."""
            group, packer, out = None, None, None
            for batch in batches:
                for of, length, *piece in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), *(batch.column(c).to_pylist() for c in names[:-4]), strict=True):
                    if of != group:
                        if out:
                            out.finish(packer)
                            yield from rows(out)
                        group, packer, out = of, BestFit(capacity, open_bins), _Numbered(round_, of, spare, last)
                    for pieces in packer.add(length, tuple(piece)):
                        out.close(pieces)
            if out:
                out.finish(packer)
                yield from rows(out)

        return repack

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(text_column).alias("text"))
    packed = materialize(source.mapInArrow(first, schema), "packed")
    done, round_ = [packed.where("closed")], 0
    left = packed.where("not closed")
    groups = 1 + (left.agg(F.max(F.expr(_GROUP))).first()[0] or 0)
    while True:
        round_, fewer = round_ + 1, -(-groups // MERGE)
        merged = left.withColumn("group", F.expr(f"floor(({_GROUP}) * {fewer} / {groups})").cast("bigint")).repartition("group").sortWithinPartitions("group", "sequence_id", "offset")
        merged = merged.mapInArrow(again(round_, fewer == 1), schema)
        if fewer == 1:
            done.append(merged)
            break
        merged = materialize(merged, "packed")
        done.append(merged.where("closed"))
        left, groups = merged.where("not closed"), fewer
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
