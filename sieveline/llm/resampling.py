"""Importance resampling towards a target's distribution of hashed n-grams.

Words become numbers, and the texts of a block one array of them. Its suffix
array, sorted as deep as the longest n-gram, puts equal n-grams side by side:
where neighbours have g words in common (their LCP), a run of one n-gram of g
words goes on. Each run is hashed once, however often its n-gram occurs, and
its bucket is scattered back to the places of the occurrences, from which the
texts are counted and scored. Counts of buckets, not of n-grams, are shuffled.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, unused

BUCKETS = 10_000
#: Words of a block, and bytes of a long text that are split into words at a time.
BLOCK_WORDS, SECTION = 1 << 20, 4 << 20
#: Words are runs of letters, digits and all that isn't ASCII; A-Z become a-z, other characters part words.
_PARTED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _sections(text: bytes, size: int):
    """The words of a whole text, in lists of about ``size`` bytes."""
    text, at = text.translate(_PARTED), 0
    while at < len(text):
        cut = text.find(b" ", at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def _blocks(texts, longest: int, block_words: int, section: int):
    """``words, row, size, carry`` of blocks: lists of words, and for each piece its text's row, its words and how many of them the piece before it had, too.

    A text is one piece unless it is longer than a section or a block ends in it.
    """
    words, row, size, carry = [], [], [], []
    for n, text in enumerate(texts):
        last = []
        for some in _sections(text, section):
            words += last
            words += some
            row.append(n)
            size.append(len(last) + len(some))
            carry.append(len(last))
            last = (last + some[-longest:])[1 - longest :] if longest > 1 else []
            if len(words) >= block_words:
                yield words, row, size, carry
                words, row, size, carry = [], [], [], []
    if words:
        yield words, row, size, carry


def _suffixes(ids: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Places in the order of the words that follow, ``longest`` of them or up to their piece's end."""
    at = np.arange(len(ids))
    rank, depth = ids + 1, 1
    while True:
        if depth >= longest:
            return np.argsort(rank)
        follows = np.where(left > depth, rank[np.minimum(at + depth, len(ids) - 1)], 0)
        pair = rank * (int(rank.max(initial=0)) + 1) + follows
        depth *= 2
        if depth >= longest:
            return np.argsort(pair)
        rank = np.unique(pair, return_inverse=True)[1] + 1


def block_buckets(words: list[bytes], size: np.ndarray, carry: np.ndarray, longest: int, buckets: int) -> list[np.ndarray]:
    """For n-grams of 1 to ``longest`` words the bucket of the one that begins at each place, or -1 for none."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(ids))
    left = ends - at
    repeated = np.repeat(np.cumsum(size) - size + carry, size) - at  # words from here that the piece before had, too
    order = _suffixes(ids, left, longest)
    common = np.ones(len(ids) - 1, bool)
    crc, run = [], np.zeros(0, np.int64)
    out = []
    for g in range(1, longest + 1):
        # runs of suffixes that have g words in common with their neighbour
        deep = left[order] >= g
        word = np.where(deep, ids[np.minimum(order + g - 1, len(ids) - 1)], -1)
        common &= (word[1:] == word[:-1]) & deep[1:]
        new = np.append(True, ~common)
        first = order[new]
        held = deep[new]
        if g == 1:
            crc = [crc32(words[i]) for i in first]
        else:
            above = run[new]
            crc = [crc32(words[i + g - 1], crc32(b" ", crc[r])) if ok else 0 for i, r, ok in zip(first.tolist(), above.tolist(), held.tolist(), strict=True)]
        run = np.cumsum(new) - 1
        bucket = np.where(held, np.array(crc, np.int64) % buckets, -1)
        found = np.empty(len(ids), np.int64)
        found[order] = bucket[run]
        found[repeated >= g] = -1  # counted with the piece before
        out.append(found)
    return out


def _by_block(batches, longest: int, buckets: int, block_words: int, section: int):
    """``batch, row, size, found``: see :func:`block_buckets`; a batch's first block comes with the batch, later ones with None."""
    for batch in batches:
        texts, fresh = (x.as_py() for x in batch.column(batch.num_columns - 1)), batch
        for words, row, size, carry in _blocks(texts, longest, block_words, section):
            size, carry = np.array(size), np.array(carry)
            found = block_buckets(words, size, carry, longest, buckets)
            yield fresh, np.array(row), size, carry, found
            fresh = None
        if fresh is not None:
            yield fresh, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []


def _texts(docs: DataFrame, text_column: str):
    return F.encode(text_or_empty(text_column), "UTF-8").alias("text")


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = BUCKETS, text_column: str = "text", block_words: int = BLOCK_WORDS, section: int = SECTION) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, _, found in _by_block(batches, longest, buckets, block_words, section):
            for of in found:
                total += np.bincount(of[of >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    made = docs.select(_texts(docs, text_column)).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[made["bucket"].to_numpy()] = made["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the source, both with one added to each bucket."""
    n, (s_all, t_all) = len(source), (int(source.sum()), int(target.sum()))
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS, section: int = SECTION) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``, all long.

    Features are all runs of 1 to ``longest`` words, repeats counted. A text's
    weight is the mean, rounded down, of its features' gains for the
    distribution of ``target``; zero without a feature. The score adds Gumbel
    noise drawn from ``seed`` and the id, so that taking the highest scores
    draws without replacement by importance. Null and empty texts have no
    feature; long ones are worked on in sections, whole. A null id draws its
    noise like an empty one. Repeated rows stay, with equal scores. With an
    empty target, or an empty table, the counts are zeros. Other columns are
    left out.
    """
    gain = gains(*(bucket_counts(x, longest, buckets, text_column, block_words, section) for x in (docs, target)))

    def score(batches):
        ids, sums = None, []
        for fresh, row, size, carry, found in _by_block(batches, longest, buckets, block_words, section):
            if fresh is not None:
                if ids is not None:
                    yield weighed(ids, *sums)
                ids, sums = fresh.column(0), [np.zeros(fresh.num_rows, np.int64) for _ in range(3)]
            if len(row):
                np.add.at(sums[0], row, size - carry)
                full = size > 0
                starts = (np.cumsum(size) - size)[full]
                for of in found:
                    np.add.at(sums[1], row[full], np.add.reduceat((of >= 0).astype(np.int64), starts))
                    np.add.at(sums[2], row[full], np.add.reduceat(np.where(of >= 0, gain[of], 0), starts))
        if ids is not None:
            yield weighed(ids, *sums)

    def weighed(ids, words, features, total):
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    made = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), _texts(docs, text_column)).mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return made.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("bigint").alias("score"))


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... of the highest scores, ties by the smaller id (null ids last), of rows with ``least_words`` words; null for rows not drawn.

    Of N such rows ``percent`` N / 100 are drawn, rounded down. They are
    sorted by range; only the ranges' sizes meet on the driver, so no task
    sees more than a range. ``rank`` of ``weighed``, if there is one, is
    replaced.
    """
    place, part, before = unused(weighed, "_place", "_part", "_before")
    weighed = materialize(weighed.drop("rank"), "weighed")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranged = materialize(weighed.where(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1))
    sizes = sorted((r[part], r["count"]) for r in ranged.groupBy(part).count().collect())
    total = sum(n for _, n in sizes)
    starts, sofar = [], 0
    for k, n in sizes:
        starts.append((k, sofar))
        sofar += n
    known = F.broadcast(weighed.sparkSession.createDataFrame(starts, f"{part} bigint, {before} bigint"))
    rank = F.col(before) + F.col(place) + 1
    ranked = ranged.join(known, part).withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop(place, part, before)
    return ranked.unionByName(weighed.where(~fit).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_column: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose ids are drawn; see :func:`weigh` and :func:`draw`. Rows without an id aren't kept."""
    drawn = draw(weigh(docs, target, id_column=id_column, **how), percent, least_words).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs[id_column].cast("bigint") == drawn["_drawn"], "left_semi")


def resampled_ranks(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


RANKS_SQL = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries),
texts AS (SELECT row_number() OVER () AS n, doc_id, text, 'source' AS side FROM documents UNION ALL SELECT row_number() OVER (), item_id, text, 'target' FROM benchmark),
split AS (
  SELECT n, doc_id, side,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
),
features AS (
  SELECT n, side, unnest(words) AS feature FROM split
  UNION ALL
  SELECT n, side, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split WHERE len(words) > 1
),
counted AS (SELECT n, side, feature, count(*) AS times FROM features GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(hex(feature), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc_table
),
bucketed AS (SELECT n, side, bucket, sum(times) AS times FROM counted JOIN hashed USING (feature) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(times) FILTER (side = 'source'), 0)::DOUBLE AS s, coalesce(sum(times) FILTER (side = 'target'), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT n, sum(times)::BIGINT AS n_features, floor(sum(times * gain) / sum(times))::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 'source' GROUP BY n),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (n) WHERE side = 'source'
),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS fit
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM ranked
"""
