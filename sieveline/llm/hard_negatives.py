"""Hard negatives: rows of another label that score close below an anchor's positives.

All vectors are turned into the axes of their principal components, which
leaves inner products as they are but gathers most of them in the leading
components. A product is added up over those first; what the others can still
add is bounded by the product of the two remainders' norms, plus slack for
rounding. A pair that can't reach what is needed any more, or can't stay below
what is allowed, is discarded there. The survivors' scores are worked out from
the integers, so results are exact.

Anchors are held by tasks in groups of ``ANCHORS``; all rows stream past them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Anchors that a task holds; rows that stream past them in one task, at least and at most; rows looked at together.
ANCHORS, FEWEST_ROWS, MOST_ROWS, BLOCK = 8_192, 1_024, 1 << 20, 512
#: Pairs whose components are multiplied together.
PAIRS = 1 << 14
#: Tasks that rows are spread over as long as none gets more than ``MOST_ROWS``.
SPREAD = 64
_NONE = np.iinfo(np.int64).min
#: Shares of the components after which pairs are discarded.
STAGES = (8, 4, 2)


def _matrix(column, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def prepare(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | str = "label") -> DataFrame:
    """``vec_id, label, q``: rows that take part, components multiplied by ``scale`` and rounded down.

    Left out are rows with a null id, label, vector or component, with a
    component that isn't finite, and with a vector so long (2 ** 31 after
    scaling) that products wouldn't fit into a long.
    """
    x = F.col(vector_column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 2.0**31))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), x.cast("array<double>").alias("x"), odd.alias("odd"))
    rows = rows.where("vec_id is not null and label is not null and x is not null and not odd").select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))
    return rows.where(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v) < 2.0**62)


def rotation(prepared: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of all vectors, the leading first; tasks hold one square matrix."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            q = _matrix(batch.column(0), width).astype(float)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["axis", "row"])

    def added(table: pa.Table) -> pa.Table:
        rows = table["row"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"axis": table["axis"][:1], "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    schema = "axis bigint, row array<double>"
    made = prepared.select("q").mapInArrow(moments, schema).groupBy("axis").applyInArrow(added, schema).toArrow()
    if not made.num_rows:
        return np.eye(width)
    moment = np.zeros((width, width))
    moment[made["axis"].to_numpy()] = made["row"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return np.linalg.eigh((moment + moment.T) / max(1.0, np.abs(moment).max()))[1][:, ::-1].copy()


class _Side:
    """Vectors of one side: integers, turned components, and the norms of what is left after each stage."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, turn: np.ndarray, cuts: list[int]):
        self.ids, self.labels, self.q = ids, labels, q
        self.y = q @ turn
        squares = np.cumsum((self.y**2)[:, ::-1], 1)[:, ::-1]
        self.rest = {k: np.sqrt(squares[:, k]) if k < q.shape[1] else np.zeros(len(q)) for k in cuts}
        self.norm = np.sqrt(squares[:, 0]) if q.shape[1] else np.zeros(len(q))

    def take(self, at) -> _Side:
        out = object.__new__(_Side)
        out.ids, out.labels, out.q, out.y, out.norm = self.ids[at], self.labels[at], self.q[at], self.y[at], self.norm[at]
        out.rest = {k: v[at] for k, v in self.rest.items()}
        return out


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``; some pairs at a time, as rows are copied for it."""
    out = np.empty(len(i), a.dtype)
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        np.einsum("ij,ij->i", a[i[some]], b[j[some]], out=out[some])
    return out


def survivors(a: _Side, b: _Side, cuts: list[int], least: np.ndarray, most: np.ndarray, unlike: bool, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows of ``a`` and ``b``) whose score may be at least ``least`` and at most ``most`` of the anchor, and their exact scores."""
    k = cuts[0]
    part = a.y[:, :k] @ b.y[:, :k].T
    room = a.rest[k][:, None] * b.rest[k] + slack * a.norm[:, None] * b.norm + 0.5
    keep = (part + room >= least[:, None]) & (part - room <= most[:, None])
    if unlike:
        keep &= a.labels[:, None] != b.labels
    i, j = np.nonzero(keep)
    part = part[i, j]
    for before, k in zip(cuts, cuts[1:], strict=False):
        part = part + _products(a.y[:, before:k], b.y[:, before:k], i, j)
        room = a.rest[k][i] * b.rest[k][j] + slack * a.norm[i] * b.norm[j] + 0.5
        keep = (part + room >= least[i]) & (part - room <= most[i])
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, _products(a.q, b.q, i, j)


class _Best:
    """The best ``n`` (score, id) of each slot, ties by the smaller id."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.score, self.id = np.full((slots, n), _NONE), np.zeros((slots, n), np.int64)

    def least(self) -> np.ndarray:
        """The score from which on a slot may still take a row."""
        return self.score[:, -1] if self.n else np.full(len(self.score), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        enters = score >= self.least()[slot]
        slot, score, ids = slot[enters], score[enters], ids[enters]
        if not len(slot):
            return
        changed, at = np.unique(slot, return_inverse=True)
        held = self.score[changed] != _NONE
        all_at = np.concatenate([np.nonzero(held)[0], at])
        all_score = np.concatenate([self.score[changed][held], score])
        all_id = np.concatenate([self.id[changed][held], ids])
        order = np.lexsort([all_id, -all_score, all_at])
        all_at, all_score, all_id = all_at[order], all_score[order], all_id[order]
        place = np.arange(len(order)) - np.searchsorted(all_at, all_at)
        best = place < self.n
        self.score[changed] = _NONE
        self.score[changed[all_at[best]], place[best]] = all_score[best]
        self.id[changed[all_at[best]], place[best]] = all_id[best]


def _cells(prepared: DataFrame, anchors: DataFrame, extra: list[str], n_rows: int, n_anchors: int) -> DataFrame:
    """All rows and the anchors, dealt to cells of a group of anchors and a share of the rows; in a cell the anchors come first, each by id."""
    shares = -(-n_rows // min(MOST_ROWS, max(FEWEST_ROWS, n_rows // SPREAD)))
    groups = -(-n_anchors // ANCHORS)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    nothing = [F.lit(None).cast(dict(anchors.dtypes)[c]).alias(c) for c in extra]
    streamed = prepared.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), own.alias("share"), F.lit(1).alias("kind"), "vec_id", "label", "q", *nothing)
    held = anchors.select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "vec_id", "label", "q", *extra)
    return streamed.unionByName(held).repartition(shares * groups, "group", "share").sortWithinPartitions("group", "share", "kind", "vec_id", "label", "q")


def _runs(batches):
    """``first, table``: rows of one cell and kind, ids once each (the first in order); ``first`` tells that the cell is new."""
    cell, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([table[c].to_numpy() for c in ("group", "share", "kind")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            some, of = table.slice(lo, hi - lo), tuple(key[lo])
            ids = some["vec_id"].to_numpy()
            new = np.append(last != (of, ids[0]), ids[1:] != ids[:-1])
            last = (of, ids[-1])
            yield of[:2] != cell, of[2], some.filter(pa.array(new))
            cell = of[:2]


def _search(cells: DataFrame, started, schema: str, turn, width: int, slack: float) -> DataFrame:
    """What ``started(anchors, table)`` makes of each cell: an object with ``look(rows)`` and ``result()``."""
    cuts = sorted({max(1, width // s) for s in STAGES}) or [0]

    def side(table):
        return _Side(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["q"], width), turn.value, cuts)

    def run(batches):
        held, search = [], None
        for first, kind, table in _runs(batches):
            if first:
                if search is not None:
                    yield from search.result()
                held, search = [], None
            if kind == 0:
                held.append(table)
                continue
            if not held:
                continue
            if search is None:
                known = pa.concat_tables(held).combine_chunks()
                search = started(side(known), known, cuts, slack)
            for lo in range(0, table.num_rows, BLOCK):
                search.look(side(table.slice(lo, BLOCK)))
        if search is not None:
            yield from search.result()

    return cells.mapInArrow(run, schema)


class _Positives:
    """The best rows of an anchor's own label."""

    def __init__(self, n: int, anchors: _Side, cuts: list[int], slack: float):
        self.anchors, self.cuts, self.slack = anchors, cuts, slack
        self.best = _Best(len(anchors.ids), n)
        self.of = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels).tolist()}

    def look(self, rows: _Side) -> None:
        for label in np.unique(rows.labels).tolist():
            if label not in self.of:
                continue
            at, b = self.of[label], rows.take(rows.labels == label)
            least = self.best.least()[at].astype(float)
            for lo in range(0, len(at), BLOCK):
                i, j, score = survivors(self.anchors.take(at[lo : lo + BLOCK]), b, self.cuts, least[lo : lo + BLOCK], np.full(len(at[lo : lo + BLOCK]), np.inf), False, self.slack)
                i = at[lo:][i]
                other = self.anchors.ids[i] != b.ids[j]
                self.best.add(i[other], score[other], b.ids[j][other])

    def result(self):
        i, k = np.nonzero(self.best.score != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.anchors.ids[i], self.best.id[i, k], self.best.score[i, k])], names=["anchor_id", "id", "score"])


class _Negatives:
    """For each positive of an anchor the best rows of other labels in the positive's band of scores."""

    def __init__(self, n: int, low: int, high: int, anchors: _Side, table: pa.Table, cuts: list[int], slack: float):
        self.anchors, self.cuts, self.slack = anchors, cuts, slack
        lists = table["positives"].combine_chunks()
        self.anchor = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        self.id, score = (np.asarray(flat.field(f).to_numpy(zero_copy_only=False), np.int64) for f in ("id", "score"))
        self.score = score
        # in Python's integers: a long times 100 may not fit
        self.low = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
        self.high = np.array([high * s // 100 for s in score.tolist()], np.int64)
        self.best = _Best(len(score), n)
        self.slots = np.full((len(lists), max(1, np.bincount(self.anchor, minlength=1).max(initial=0))), -1)
        self.slots[self.anchor, np.arange(len(self.anchor)) - np.searchsorted(self.anchor, self.anchor)] = np.arange(len(self.anchor))

    def look(self, rows: _Side) -> None:
        n = len(self.anchors.ids)
        needs = np.where(self.low > self.high, np.inf, np.maximum(self.low, self.best.least()).astype(float))
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, self.anchor, needs)
        np.maximum.at(most, self.anchor, self.high.astype(float))
        for lo in range(0, n, BLOCK):
            some = slice(lo, lo + BLOCK)
            i, j, score = survivors(self.anchors.take(some), rows, self.cuts, least[some], most[some], True, self.slack)
            for slot in self.slots[some].T:
                of = slot[i]
                fit = (of >= 0) & (score >= self.low[of]) & (score <= self.high[of])
                self.best.add(of[fit], score[fit], rows.ids[j[fit]])

    def result(self):
        i, k = np.nonzero(self.best.score != _NONE)
        columns = (self.anchors.ids[self.anchor[i]], self.id[i], self.score[i], self.best.id[i, k], self.best.score[i, k])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(prepared: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``prepared`` comes from :func:`prepare`; anchors are its rows with
    ``is_anchor``. An anchor's positives are the ``positives`` best other rows
    of its label; for each of them the ``negatives`` best rows of other labels
    with ``low`` to ``high`` per cent of the positive's score are returned,
    ranked from 1. Higher integer products come first, ties by the smaller id;
    as in a negative score's band nothing can be, its positive has no row, nor
    has one without a row in its band. Missing components at the end of a
    shorter vector count as zero. Of rows with the same id the first by label
    and vector takes part. Without anchors, and for an empty table, the result
    is empty. All anchors meet all rows, in cells whose anchors are bounded;
    cells hand on their best rows only.
    """
    spark = prepared.sparkSession
    prepared = materialize(prepared.select("vec_id", "label", "q"), "vectors")
    n_rows, width = prepared.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    anchors = prepared.where(is_anchor)
    n_anchors = anchors.count()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], result)
    matrix = rotation(prepared, width)
    # rounding of turned components and of their products, and how far the matrix is from orthogonal
    apart = np.abs(matrix.T @ matrix - np.eye(width)).max(initial=0)
    slack = width * (16 * width**0.5 * np.finfo(float).eps + apart)
    turn = spark.sparkContext.broadcast(matrix)

    def own(side, table, cuts, slack):
        return _Positives(positives, side, cuts, slack)

    def others(side, table, cuts, slack):
        return _Negatives(negatives, low, high, side, table, cuts, slack)

    found = _search(_cells(prepared, anchors, [], n_rows, n_anchors), own, "anchor_id bigint, id bigint, score bigint", turn, width, slack)
    ordered = lambda score, *carried: F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("below"), *carried)))
    best = found.groupBy("anchor_id").agg(F.slice(ordered("score", "id", "score"), 1, positives).alias("positives"))
    held = materialize(anchors.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives")), "positives")
    found = _search(_cells(prepared, held, ["positives"], n_rows, n_anchors), others, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", turn, width, slack)
    best = found.groupBy("anchor_id", "positive_id").agg(F.first("positive_score").alias("positive_score"), F.slice(ordered("negative_score", "negative_id", "negative_score"), 1, negatives).alias("best"))
    rows = best.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n"))
    return rows.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n")["negative_id"].alias("negative_id"), "positive_score", F.col("n")["negative_score"].alias("negative_score"))


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50; a seventh of the labels is moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepare(vectors, label=label), F.col("vec_id") % 50 == 0)


MINED_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label, list_dot_product(a.q, v.q)::BIGINT AS score
  FROM vectors a JOIN vectors v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, anchor_label FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
