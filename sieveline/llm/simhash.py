"""Near-duplicates by SimHash and a binary trie self-join.

Fingerprints are made once per document and the distinct ones are linked. The
sorted fingerprints of a group form a binary trie that is joined with itself:
pairs of nodes go down together, several bits at a time, differing bits add
up, and a pair is dropped as soon as it exceeds the budget, or if all below it
is tied already.

Groups come in two ways.

``links`` (64 bits, small budgets) loses no link: the bits are cut into runs,
and two fingerprints within ``budget`` bits agree on all but ``budget`` runs,
so each is dealt out by its bits on every such choice of runs. Fingerprints in
groups that too many share are dealt out again by a finer cut, which is
complete in itself; the finest leaves so few bits free that a group is bounded.

``wide_links`` (256 bits, budgets for a similarity of 0.8) would need far too
many choices of bits. Its groups come from the shingles instead: two sets of
shingles have the same least hash with a probability that equals their
similarity. A group agrees on the least hashes of several hash functions, and
there are several such choices, worked out from the similarity so that a pair
is in no group together with a small, stated probability; the functions to
agree on grow with the number of rows, and the choices with them, but slowly.
What the wide trie finds are candidates. They are held against each other by
their sets of shingles, exactly, before anything is tied together. Groups that
too many rows share are cut for a first pass, which ties what is closest; then
all rows of such a group that aren't tied meet each other, block by block.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import keep_named
from .common import broadcast_if_small, materialize, text_or_empty
from .components import components

BITS = 64
#: Distinct fingerprints in one group; those of larger groups are dealt out again.
GROUP = 2_000
#: Choices of runs that a fingerprint is dealt out by at most.
MASKS = 1_000
#: Rows up to which a list of rows is sent to all executors; a longer one is shuffled.
BROADCAST_ROWS = 50_000
#: Bits by which a trie of 64 or 256 bits goes down at a time, node pairs looked at together, and rows and bytes of whole groups joined together.
STEP, WIDE_STEP, PAIRS, CHUNK, CHUNK_BYTES = 4, 16, 1 << 20, 100_000, 64 << 20

#: Words of 64 bits in a wide fingerprint.
WORDS = 4
#: Similarity of sets of shingles to be found, and the bits of 256 that a candidate pair may differ in (38.7 on average at that similarity, deviation 5.7).
SIMILAR, WIDE_BUDGET = 0.8, 52
#: Probability that no choice of least hashes brings a pair of that similarity together.
MISSED = 0.005


def _shingles(text: bytes, shingle: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def _hashes(shingles: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8", len(shingles))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes (or rows of hashes) have each bit, bit 0 first."""
    width = math.prod(hashes.shape[1:])
    of = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8 * width)
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(of), 255):  # so that sums fit into a byte
        ones += np.unpackbits(of[at : at + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return ones


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text given as UTF-8; zero if it has no word."""
    hashes = _hashes(_shingles(text, shingle))
    return int(np.packbits(2 * _ones(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """The ``n``-th further hash made from each hash."""
    with np.errstate(over="ignore"):
        z = hashes + np.asarray(n, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: bytes, shingle: int = 5, functions: int = 0) -> tuple[bytes, bytes]:
    """SimHash of the set of a text's shingles, ``WORDS`` words wide, zero if it has no word; and the set's least hashes by that many hash functions, 32 bits of each."""
    hashes = np.unique(_hashes(_shingles(text, shingle)))
    ones, least = np.zeros(64 * WORDS, np.int64), np.full(functions, -1, np.int64).view(np.uint64)
    odd = _mixed(np.arange(functions, dtype=np.uint64), 1) | np.uint64(1)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096, None]
        ones += _ones(_mixed(some, np.arange(WORDS)))
        least = np.minimum(least, (odd[:, None] * some[:, 0]).min(1))
    return np.packbits(2 * ones > len(hashes)).tobytes(), least.astype("<u4").tobytes()


def _fingerprinted(docs: DataFrame, make, fields: list[pa.Field], sql: str, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, key`` of every row, a hash of its text, and what ``make`` makes of the whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), *fields])

    def run(batches):
        for batch in batches:
            made = [make(x.as_py()) for x in batch.column(2)]
            columns = [pa.array([m[i] for m in made], field.type) for i, field in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.encode(text_or_empty(text_column), "UTF-8").alias("text"))
    return source.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id bigint, key bigint, {sql}")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, key, fp`` of every row, ``fp`` as a signed long."""
    return _fingerprinted(docs, lambda text: (_signed(fingerprint(text, shingle)),), [pa.field("fp", pa.int64())], "fp bigint", id_column, text_column)


def wide_fingerprints(docs: DataFrame, functions: int, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, key, fp, least`` of every row, the last two as bytes."""
    fields = [pa.field("fp", pa.binary()), pa.field("least", pa.binary())]
    return _fingerprinted(docs, partial(wide_fingerprint, shingle=shingle, functions=functions), fields, "fp binary, least binary", id_column, text_column)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


# --- the trie -------------------------------------------------------------------


def _bit_length(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _shared_bits(keys: np.ndarray) -> np.ndarray:
    """First bits that each row of words has in common with the row before; none for the first."""
    apart = keys[1:] ^ keys[:-1]
    word = np.argmax(apart != 0, axis=1)
    return np.append(0, 64 * word + 64 - _bit_length(apart[np.arange(len(apart)), word]))


def _tied(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after the leaves ``a`` and ``b`` were tied pair by pair; a label is the first leaf of its group."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        labels = parent[labels]


def _tied_if(labels: np.ndarray, a: np.ndarray, b: np.ndarray, alike) -> np.ndarray:
    """``labels`` after those of the pairs ``a, b`` were tied that ``alike`` tells to be; pairs that others have tied already aren't asked for."""
    few = 1
    while True:
        x, y = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return labels
        # of the pairs between two groups a few at first: one is enough to tie them
        order = np.lexsort([y, x])
        new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
        starts = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        asked = np.zeros(len(a), bool)
        asked[order[place < few]] = True
        same = alike(a[asked], b[asked])
        labels = _tied(labels, a[asked][same], b[asked][same])
        a, b, few = a[~asked], b[~asked], 2 * few


class _Similar:
    """Whether sets of hashes (sorted arrays) have a similarity of ``share``, a pair of integers, or more."""

    def __init__(self, sets: list[np.ndarray], share: tuple[int, int] = (4, 5)):
        self.sets, self.share, self.sizes = sets, share, np.array([len(x) for x in sets])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        part, whole = self.share
        both = self.sizes[a] + self.sizes[b]
        out = whole * np.minimum(self.sizes[a], self.sizes[b]) >= part * np.maximum(self.sizes[a], self.sizes[b])
        for n in np.flatnonzero(out).tolist():
            common = len(np.intersect1d(self.sets[a[n]], self.sets[b[n]], assume_unique=True))
            out[n] = whole * common >= part * (both[n] - common)
        return out


class _Trie:
    """Sorted distinct ``keys`` (rows of 64-bit words); ``roots`` are the first rows of groups, level k has a node for each prefix of ``depths[k - 1]`` bits."""

    def __init__(self, keys: np.ndarray, shared: np.ndarray, roots: np.ndarray, depths: list[int]):
        self.keys, self.starts, self.steps, above = keys, [roots], [(0, np.uint64(0))], 0
        first = np.zeros(len(keys), bool)
        first[roots] = True
        for depth in depths:
            self.starts.append(np.flatnonzero(first | (shared < depth)))
            word, low = (depth - 1) // 64, 64 * ((depth - 1) // 64 + 1) - depth
            self.steps.append((word, np.uint64(((1 << (depth - max(above, 64 * word))) - 1) << low)))
            above = depth
        # the first child of each node, and one past the last
        self.children = [np.append(np.searchsorted(low, high), len(low)) for high, low in zip(self.starts, self.starts[1:], strict=False)]

    def tie(self, budget: int, labels: np.ndarray, alike=None, pairs=None) -> np.ndarray:
        """``labels`` after all leaves within ``budget`` bits (and ``alike``, if given) were tied; node pairs below which all is tied aren't followed.

        The leaves of each root are held against each other, or those of the
        ``pairs`` of roots, if given.
        """
        a, b = pairs or (np.arange(len(self.starts[0])),) * 2
        stack, fresh = [(0, a, b, np.zeros(len(a), np.int16))] if len(a) else [], False
        while stack:
            level, a, b, spent = stack.pop()
            if level == len(self.steps) - 1:
                labels, fresh = _tied(labels, a, b) if alike is None else _tied_if(labels, a, b, alike), False
                continue
            if not fresh:
                least, most = ([f.reduceat(labels, s) for s in self.starts] for f in (np.minimum, np.maximum))
                fresh = True
            first = self.children[level]
            width = first[b + 1] - first[b]
            made = (first[a + 1] - first[a]) * width
            total = np.cumsum(made)
            if total[-1] > PAIRS and len(a) > 1:
                cut = min(len(a) - 1, max(1, int(np.searchsorted(total, PAIRS))))
                stack += [(level, a[cut:], b[cut:], spent[cut:]), (level, a[:cut], b[:cut], spent[:cut])]
                continue
            of = np.repeat(np.arange(len(a)), made)
            n = np.arange(total[-1]) - np.repeat(total - made, made)
            i, j = first[a][of] + n // width[of], first[b][of] + n % width[of]
            low, high, s = least[level + 1], most[level + 1], self.starts[level + 1]
            follow = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])) & ((a[of] != b[of]) | (i <= j))
            of, i, j = of[follow], i[follow], j[follow]
            word, step = self.steps[level + 1]
            column = self.keys[:, word]
            cost = spent[of] + np.bitwise_count((column[s[i]] ^ column[s[j]]) & step).astype(np.int16)
            keep = cost <= budget
            if keep.any():
                stack.append((level + 1, i[keep], j[keep], cost[keep]))
        return labels

    def links(self, budget: int, alike=None, given: np.ndarray | None = None, pairs=None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the first rows of the groups they are tied into; of groups ``given`` as their first rows, those that are tied further. The budget grows, so that dense groups are tied by their closest pairs."""
        labels = given = np.arange(len(self.keys)) if given is None else given
        for allowed in sorted({-(-budget // 3), -(-2 * budget // 3), budget}):
            labels = self.tie(allowed, labels, alike, pairs)
        linked = np.flatnonzero((labels != given) & (given == np.arange(len(labels))))
        return linked, labels[linked]


def trie_links(fps: np.ndarray, mask: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together all of ``fps`` that is within ``budget`` bits and agrees on ``mask``'s bits: each fingerprint and its group's first.

    Repeated fingerprints count once.
    """
    fps = np.unique(fps)
    keys = np.stack([fps & np.uint64(mask), fps & ~np.uint64(mask)], 1)
    order = np.lexsort([keys[:, 1], keys[:, 0]])
    keys, fps = keys[order], fps[order]
    shared = _shared_bits(keys)
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    depths = sorted({128 - b for b in free[STEP - 1 :: STEP] + free[-1:]})
    linked, to = _Trie(keys, shared, np.flatnonzero(shared < 64) if mask else np.arange(min(1, len(fps))), depths).links(budget)
    return fps[linked], fps[to]


# --- groups without a lost link ---------------------------------------------------


def _masks(parts: int, budget: int) -> list[int]:
    """The bits are cut into ``parts`` runs; every choice of all but ``budget`` of them."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    runs = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, parts - budget)]


def _by_group(batches, columns: list[str], chunk: int, chunk_bytes: int = 1 << 62):
    """Tables of whole groups (rows alike in ``columns``, which come together), of about ``chunk`` rows, ``chunk_bytes`` bytes or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < chunk and sum(x.nbytes for x in held) < chunk_bytes:
            continue
        rows = pa.Table.from_batches(held)
        changes = np.zeros(rows.num_rows - 1, bool)
        for name in columns:
            values = rows[name].to_numpy()
            changes |= values[1:] != values[:-1]
        at = np.flatnonzero(changes)
        if len(at):
            yield rows.slice(0, int(at[-1]) + 1)
            held = rows.slice(int(at[-1]) + 1).combine_chunks().to_batches()
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, budget: int = 3, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links between the distinct fingerprints in column ``fp`` that tie all within ``budget`` bits.

    A group of the finest cut has at most ``2 ** (64 * budget / parts)``
    fingerprints: 65,536 for a budget of 3. Groups of more than ``group`` are
    dealt out again; ``chunk`` rows of whole groups are joined together.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches):
        for rows in _by_group(batches, ["mask", "value"], chunk):
            fps, masks = rows["fp"].to_numpy().view(np.uint64), rows["mask"].to_numpy().view(np.uint64)
            for mask in np.unique(masks):
                a, b = trie_links(fps[masks == mask], int(mask), budget)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    cuts = [parts for parts in ((budget + 1) * n for n in (1, 2, 3)) if parts == budget + 1 or math.comb(parts, budget) <= MASKS]
    rows, done = distinct.select("fp"), []
    for parts in cuts:
        masks = F.array(*(F.lit(_signed(m)).cast("bigint") for m in _masks(parts, budget)))
        dealt = rows.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.expr("fp & mask"))
        if parts != cuts[-1]:
            crowded = materialize(dealt.groupBy("mask", "value").count().where(F.col("count") > group).select("mask", "value"), "crowded")
        if parts == cuts[-1] or crowded.isEmpty():
            done.append(dealt)
            break
        known = broadcast_if_small(crowded, BROADCAST_ROWS)
        done.append(dealt.join(known, ["mask", "value"], "left_anti"))
        # two fingerprints whose groups are all crowded are both dealt out again
        rows = materialize(dealt.join(known, ["mask", "value"], "left_semi").select("fp").distinct(), "again")
    rows = reduce(DataFrame.unionByName, (part.select("fp", "mask", "value") for part in done))
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value").select("fp", "mask", "value").mapInArrow(join, "a bigint, b bigint")


# --- groups by least hashes ----------------------------------------------------------


def choices(n: int) -> tuple[int, int]:
    """Least hashes that the texts of one group agree on, and how many choices of them there are, for ``n`` rows.

    Each least hash counts as four bits: texts that have nothing to do with
    each other agree on it more seldom than once in 16 times.
    """
    agreed = max(4, -(-((max(2, n) - 1).bit_length() - 4) // 4))
    return agreed, math.ceil(math.log(MISSED) / math.log(1 - SIMILAR**agreed))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _roots(shared: np.ndarray, bits: int, group: int) -> np.ndarray:
    """First rows of groups that agree on ``bits`` bits, or on more where more than ``group`` rows do."""
    first = shared < bits
    first[0] = True
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(shared)))
        crowded = np.repeat(sizes > group, sizes)
        if not crowded.any():
            return starts
        bits += 2
        first |= crowded & (shared < bits)


def _turned(fps: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints as rows of bytes, begun at another place for each ``n``."""
    return np.roll(fps, 5 * n, axis=1)


def _dealt(rows: DataFrame, agreed: int, turns: int, *carried: str) -> DataFrame:
    """``turn, head, key`` of ``rows (fp, least)`` and the ``carried`` columns: a row for each choice of least hashes, ``head`` stands for those and ``key`` begins with it."""

    def turn(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, least = _bytes(batch.column(0)), _bytes(batch.column(1)).view("<u4")
            for n in range(turns):
                head = np.zeros(len(fps), np.uint64)
                for i in range(agreed):
                    head = _mixed(head ^ least[:, n * agreed + i], 1)
                others = least[:, [((n + 1) * agreed + i) % least.shape[1] for i in range(8)]].astype(np.uint8)
                key = np.concatenate([head.astype(">u8").view(np.uint8).reshape(-1, 8), others, _turned(fps, n)], axis=1)
                columns = [pa.array(np.full(len(fps), n, np.int32)), pa.array(head.view(np.int64)), _binary(key), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["turn", "head", "key", *carried])

    types = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.select("fp", "least", *carried).mapInArrow(turn, f"turn int, head bigint, key binary{types}")


#: What links of wide fingerprints are yielded as, and where their tries have nodes.
_WIDE_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_WIDE_DEPTHS = list(range(WIDE_STEP, 64 * WORDS + 1, WIDE_STEP))


def _trie_links(dealt: DataFrame, budget: int, chunk: int, cut: int | None = None) -> DataFrame:
    """``a, b``: links within the groups of ``dealt (turn, key)``, sorted by both; exact ones if it has a ``set``.

    A group, which agrees on the first eight bytes of ``key``, is worked on
    whole. With ``cut``, groups of more rows are cut by what else they agree
    on, and where a task or a chunk ends; links between the parts are left to
    :func:`_rest_links`.
    """

    def join(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)] if batch.num_columns > 2 else []
            held.append((batch.column(0).to_numpy(), _bytes(batch.column(1)), sets))
            size += batch.nbytes
            if sum(len(x[0]) for x in held) >= chunk or size >= CHUNK_BYTES:
                found, rest = tied(held, False)
                yield from found
                held, size = [rest] if rest else [], sum(x.nbytes for x in rest[2]) if rest else 0
        if held:
            yield from tied(held, True)[0]

    def tied(held, last):
        """Links among the groups of sorted rows, and the rows of the last group, which may go on."""
        turn_of, raw, sets = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [x for h in held for x in h[2]]
        keys = raw.view(">u8").astype(np.uint64)
        new = np.flatnonzero(np.append(True, (turn_of[1:] != turn_of[:-1]) | (keys[1:] != keys[:-1]).any(1)))
        turn_of, raw, keys, sets = turn_of[new], raw[new], keys[new], [sets[i] for i in new] if sets else []
        shared = np.where(np.append(True, turn_of[1:] != turn_of[:-1]), 0, _shared_bits(keys))
        roots = _roots(shared, 64, cut or len(keys))
        end = len(keys) if last or (cut and len(roots) == 1) else int(roots[-1])
        rest = (turn_of[end:], raw[end:], sets[end:]) if end < len(keys) else None
        if not end:
            return [], rest
        roots = roots[roots < end]
        of = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, end)))
        alone = np.diff(np.append(roots, end)) == 1
        paired = np.flatnonzero(~alone[of])
        if not len(paired):
            return [], rest
        # of groups of two or more, the trie of each group's fingerprints
        fps, of = keys[paired, 2:], of[paired]
        order = np.lexsort([*fps.T[::-1], of])
        fps, paired, of = fps[order], paired[order], of[order]
        first = np.append(True, of[1:] != of[:-1])
        alike = _Similar([sets[i] for i in paired]) if sets else None
        linked, to = _Trie(fps, np.where(first, 0, _shared_bits(fps)), np.flatnonzero(first), _WIDE_DEPTHS).links(budget, alike)
        linked, to = paired[linked], paired[to]
        out = []
        for n in np.unique(turn_of[linked]):
            some = turn_of[linked] == n
            out.append(pa.RecordBatch.from_arrays([_binary(_turned(raw[x[some], 16:], -n)) for x in (linked, to)], schema=_WIDE_LINKS))
        return out, rest

    return dealt.select("turn", "key", *(c for c in dealt.columns if c == "set")).mapInArrow(join, "a binary, b binary")


def _cells(rows: DataFrame, group: int) -> DataFrame:
    """``turn, head, x, y, kind, side, fp, root`` (and ``set``): what is left to be held against each other in the groups of ``rows (turn, head, fp, root)``.

    Rows with one ``root`` are tied already. The rows of a group's commonest
    root are dealt into blocks, and so are all others; each block of others
    meets itself, the other ones and those of the commonest root in a cell
    each. A cell has two blocks, its sides, of about ``group`` rows or
    ``CHUNK_BYTES`` of sets; a group that is tied as a whole has none.
    """
    carried = [c for c in rows.columns if c == "set"]
    size = F.sum(F.octet_length("set")) if carried else F.lit(0).cast("bigint")
    by_root = rows.groupBy("turn", "head", "root").agg(F.count("*").alias("n"), size.alias("bytes"))
    groups = by_root.groupBy("turn", "head").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("most"))
    blocks = lambda n, size: F.ceil(F.greatest(n / group, size / CHUNK_BYTES)).cast("int")
    groups = groups.where(F.col("n") > F.col("most.n")).select(
        "turn",
        "head",
        F.col("most.root").alias("common"),
        blocks(F.col("most.n"), F.col("most.bytes")).alias("n_common"),
        blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("n_others"),
    )
    met = rows.join(broadcast_if_small(materialize(groups, "groups"), BROADCAST_ROWS), ["turn", "head"])
    common, n_common, n_others = F.col("root") == F.col("common"), F.col("n_common"), F.col("n_others")
    met = met.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(common, n_common).otherwise(n_others)).cast("int"))
    cell = lambda x, y, kind, side: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    each, block = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make), F.col("block")
    among = each(n_others, lambda i: cell(F.least(i, block), F.greatest(i, block), 0, i < block))
    across = each(n_common, lambda i: cell(block, i, 1, F.lit(False)))
    cells = F.when(common, each(n_others, lambda i: cell(i, block, 1, F.lit(True)))).otherwise(F.concat(among, across))
    return met.select("turn", "head", "fp", "root", *carried, F.explode(cells).alias("cell")).select("turn", "head", "cell.*", "fp", "root", *carried)


def _rest_links(cells: DataFrame, budget: int, chunk: int) -> DataFrame:
    """``a, b``: links between the two sides of each of the ``cells`` (see :func:`_cells`), or within the one side of a block that meets itself."""
    of_cell = ["turn", "head", "x", "y", "kind"]

    def join(batches):
        for rows in _by_group(batches, of_cell, chunk, CHUNK_BYTES):
            cell, side = np.zeros(rows.num_rows, bool), rows["side"].to_numpy()
            cell[0] = True
            for name in of_cell:
                values = rows[name].to_numpy()
                cell[1:] |= values[1:] != values[:-1]
            first = cell | np.append(True, side[1:] != side[:-1])
            roots = np.flatnonzero(first)
            number, (x, y, kind) = np.cumsum(cell)[roots], (rows[name].to_numpy()[roots] for name in ("x", "y", "kind"))
            itself = np.flatnonzero((kind == 0) & (x == y))
            left = np.flatnonzero(number[1:] == number[:-1])
            raw = _bytes(rows["fp"])
            fps = raw.view(">u8").astype(np.uint64)
            _, at, same = np.unique(_bytes(rows["root"]).view(">u8"), axis=0, return_index=True, return_inverse=True)
            alike = _Similar([np.frombuffer(s, "<u8") for s in rows["set"].to_pylist()]) if "set" in rows.column_names else None
            trie = _Trie(fps, np.where(first, 0, _shared_bits(fps)), roots, _WIDE_DEPTHS)
            linked, to = trie.links(budget, alike, at[same], (np.append(itself, left), np.append(itself, left + 1)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([_binary(raw[linked]), _binary(raw[to])], schema=_WIDE_LINKS)

    columns = [*of_cell, "side", "fp", "root", *(c for c in cells.columns if c == "set")]
    return cells.select(*columns).repartition(*of_cell).sortWithinPartitions(*of_cell, "side", "fp").mapInArrow(join, "a binary, b binary")


def wide_links(distinct: DataFrame, agreed: int, turns: int, budget: int = WIDE_BUDGET, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links between distinct wide fingerprints in column ``fp`` with their ``least`` hashes that tie together all pairs of a group; see the module's text for what is in no group together.

    A group (one choice of least hashes that all its rows agree on) of up to
    ``group`` rows is worked on in one task. Larger ones are sorted by the
    agreed hashes, eight other least hashes and the fingerprint, and dealt out
    by range, so that each row is held against those that it agrees with on
    more, other hashes and bits in each turn; that ties most of what is alike.
    What isn't tied after that meets in cells of two blocks of a group each,
    so no pair of a group is left out: its work grows with the untied rows of
    a large group times all its rows, a task's memory with ``group``. If the
    rows have a ``set`` of hashes, too, only those are tied that are so similar.
    """
    carried = [c for c in distinct.columns if c == "set"]
    weighed = distinct.withColumn("size", F.octet_length("set") if carried else F.lit(0))
    sizes = _dealt(weighed, agreed, turns, "size").groupBy("turn", "head").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    crowded = materialize(sizes.where((F.col("n") > group) | (F.col("bytes") > CHUNK_BYTES)).select("turn", "head"), "crowded")
    whole = lambda rows: _trie_links(rows.repartition("turn", "head").sortWithinPartitions("turn", "key"), budget, chunk)
    dealt = _dealt(distinct, agreed, turns, *carried)
    if crowded.isEmpty():
        return whole(dealt)
    known = broadcast_if_small(crowded, BROADCAST_ROWS)
    closest = dealt.join(known, ["turn", "head"], "left_semi").repartitionByRange("turn", "key").sortWithinPartitions("turn", "key")
    found = whole(dealt.join(known, ["turn", "head"], "left_anti")).union(_trie_links(closest, budget, chunk, group))
    tied = materialize(components(found), "tied")
    rooted = distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), *carried)
    rows = _dealt(materialize(rooted, "rooted"), agreed, turns, "fp", "root", *carried).join(known, ["turn", "head"], "left_semi").drop("key")
    return tied.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_rest_links(_cells(rows, group), budget, chunk))


def _member_links(members: DataFrame, budget: int, chunk: int) -> DataFrame:
    """Exact links between the ``members (root, fp, set)`` of small groups, each in one task."""
    zeros = F.lit(bytearray(8))
    dealt = members.select(F.lit(0).alias("turn"), F.concat(F.unhex(F.lpad(F.hex(F.xxhash64("root")), 16, "0")), zeros, "fp").alias("key"), "set")
    return _trie_links(dealt.repartition(F.substring("key", 1, 8)).sortWithinPartitions("turn", "key"), budget, chunk)


# --- classes ------------------------------------------------------------------------


def _distinct(made: DataFrame, *carried: str) -> DataFrame:
    """Each distinct ``fp`` of ``made (doc_id, key, fp)`` with its ``first`` row (of the smallest id; rows without one last) and one value of the ``carried`` columns."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    return materialize(made.groupBy("fp").agg(place.alias("first"), *(F.min(c).alias(c) for c in carried)), "distinct")


def _classes(made: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """``doc_id, key, fp, root, component_id`` of every row of ``made (doc_id, key, fp)``; ``root`` is one fingerprint of the row's component."""
    tied = materialize(components(linked), "components").withColumnRenamed("node", "fp")
    first = F.col("first.doc_id")
    least = distinct.join(tied, "fp").groupBy("root").agg(F.min(first).alias("component_id"))
    named = distinct.join(tied.join(least, "root"), "fp", "left")
    # written first, so that the last join reads two plain shuffles and a hot fingerprint's rows can be split
    named = materialize(named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce(F.col("component_id"), first).alias("component_id")), "named")
    return made.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    A fingerprint bit is one if more than half of the text's shingle hashes
    (XXH64 of the UTF-8 text, seed 42; repeats count) have it. Texts whose
    fingerprints differ in at most ``budget`` bits are linked; a component's
    id is the smallest document id in it. Null, empty and blank texts have
    fingerprint zero, linked like any other. Texts shorter than a shingle are
    one shingle. Repeated rows stay and share a component. A null id never
    names a component that has another id. An empty table gives an empty
    result; other columns are left out.
    """
    made = materialize(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    distinct = _distinct(made)
    found = _classes(made, distinct, links(distinct, budget))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, key, set`` of every row: the hashes of the text's shingles, sorted."""
    made = lambda text: (np.unique(_hashes(_shingles(text, shingle))).astype("<u8").tobytes(),)
    return _fingerprinted(docs, made, [pa.field("set", pa.binary())], "set binary", id_column, text_column)


def similar_links(docs: DataFrame, distinct: DataFrame, agreed: int, turns: int, shingle: int, budget: int, id_column: str, text_column: str, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that tie together what is linked by exact similarity among the candidates of the trie.

    First the trie ties fingerprints within ``budget`` bits: that finds which
    rows have a candidate at all. Of those alone the sets of shingles are made,
    from one row for each fingerprint. A loosely tied group of up to ``group``
    fingerprints and ``CHUNK_BYTES`` of sets is then worked on whole in one
    task; those of larger ones go through the choices of least hashes again,
    with their sets. In both the trie yields pairs within the budget, and what
    two sets say decides.
    """
    loose = materialize(components(wide_links(distinct, agreed, turns, budget, group, chunk)), "loose")
    members = loose.withColumnRenamed("node", "fp").join(distinct, "fp").select("fp", "root", "least", F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    members = materialize(members.withColumn("name", F.xxhash64("_id", "_key")), "members")
    named = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    named = named.withColumn("name", F.xxhash64("doc_id", F.xxhash64(F.encode(text_or_empty(), "UTF-8"))))
    sets = shingle_sets(keep_named(named, "name", members.select("name").distinct()), shingle, "doc_id", "text").dropDuplicates(["doc_id", "key"])
    made = members.join(sets, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))).select("fp", "root", "least", "set")
    made = materialize(made, "sets")
    sizes = made.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("bytes"))
    large = materialize(sizes.where((F.col("n") > group) | (F.col("bytes") > CHUNK_BYTES)).select("root"), "large")
    if large.isEmpty():
        return _member_links(made, budget, chunk)
    large = broadcast_if_small(large, BROADCAST_ROWS)
    again = made.join(large, "root", "left_semi").drop("root")
    return _member_links(made.join(large, "root", "left_anti"), budget, chunk).union(wide_links(again, agreed, turns, budget, group, chunk))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = WIDE_BUDGET, id_column: str = "doc_id", text_column: str = "text", group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """One row of each component, all its columns kept: the smallest id's; rows without an id come last.

    Texts are linked if the sets of their shingles of five words have a
    similarity of 0.8 or more. Pairs are found by their wide fingerprints,
    which differ in at most ``budget`` of 256 bits but for chance (see README
    for measured recall), and held against each other exactly, so no link is
    wrong; ``group`` and ``chunk`` bound what a task joins together. Of rows
    alike in id and text any one stays. Null, empty and blank texts are one
    component; a text of less than five words is one shingle; very long texts
    are read whole. An empty table stays empty. Columns may have any names.
    The rows are counted first, which a Parquet table answers without reading
    texts.
    """
    agreed, turns = choices(docs.count())
    made = materialize(wide_fingerprints(docs, agreed * turns, shingle, id_column, text_column), "fingerprints")
    distinct = _distinct(made, "least")
    linked = similar_links(docs, distinct, agreed, turns, shingle, budget, id_column, text_column, group, chunk)
    found = materialize(_classes(made.drop("least"), distinct, linked).select("doc_id", "key", "root"), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # written first, so that the join reads two plain shuffles and a hot component's rows can be split
    first = materialize(found.groupBy("root").agg(F.min(place).alias("first")), "first")
    gone = found.join(first, "root").where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    again = found.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    gone, again = (broadcast_if_small(materialize(x, "rows"), BROADCAST_ROWS) for x in (gone, again))
    key = F.xxhash64(F.encode(F.coalesce(docs[text_column], F.lit("")), "UTF-8"))
    same = lambda x: docs[id_column].cast("bigint").eqNullSafe(x["_id"]) & (key == x["_key"])
    kept = docs.join(gone, same(gone), "left_anti")
    once = kept.join(again, same(again), "left_anti")
    return once.unionByName(kept.join(again, same(again), "left_semi").dropDuplicates([id_column, text_column]))
