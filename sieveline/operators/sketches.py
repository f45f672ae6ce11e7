"""How many different values matches have, by sketches that merge.

Exact distinct counts have to shuffle every value again for each way of
grouping. Here values go into HyperLogLog sketches at the finest grain, before
any shuffle; sums over days and over groups are made of those sketches alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of a sketch's buckets: some 4 KB each at most, and a standard error of 1.04 / 2 ** (BUCKETS / 2).
BUCKETS = 12


def standard_error(buckets: int = BUCKETS) -> float:
    """A sketch's relative standard error."""
    return 1.04 / 2 ** (buckets / 2)


def sketched(found: DataFrame, by: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """``by, n, sketch``: for each group how often ``value`` is there, and a sketch of its values.

    A null value counts nowhere; a group of only those has ``n`` 0. Groups may
    be null. Tasks send a sketch for each of their groups, never values, so a
    hot group costs no more than another.
    """
    return found.groupBy(*by).agg(F.count(value).alias("n"), F.hll_sketch_agg(F.col(value).cast("string"), buckets).alias("sketch"))


def write_day(sketches: DataFrame, path: str, day: str) -> None:
    """Keep a day's sketches, in place of any that the day had."""
    sketches.write.mode("overwrite").parquet(f"{path}/day={day}")


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The sketches of the days from ``first`` to ``last``, both included."""
    kept = spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string"))
    if first is not None:
        kept = kept.where(F.col("day") >= first)
    return kept if last is None else kept.where(F.col("day") <= last)


def every_set(by: Sequence[str]) -> list[list[str]]:
    """All sets of the columns, as a cube has them."""
    return [list(some) for k in range(len(by), -1, -1) for some in combinations(by, k)]


def summed(sketches: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """``by, level, n, n_values, sketch``: sketches summed over all other columns, for each grouping set (a cube by default).

    ``level`` tells a column that was summed over from one that is null: it has
    a bit for each of ``by``, the last one's the least, set where the column
    was summed over. ``n`` is exact, ``n_values`` has the sketch's error. No
    sketches give no rows.
    """
    grouped = sketches.groupingSets(every_set(by) if sets is None else [list(s) for s in sets], *by)
    out = grouped.agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return out.select(*by, "level", "n", F.hll_sketch_estimate("sketch").alias("n_values"), "sketch")
