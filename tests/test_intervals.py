import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.intervals import WIDTHS, line_spans, overlapping


def brute(left, right):
    met = lambda a, b: a[1] is not None and b[1] is not None and None not in (a[0], a[2], b[2]) and a[1] < max(b[2], b[1] + 1) and b[1] < max(a[2], a[1] + 1)
    return sorted((a[0], *a[1:], *b[1:]) for a in left for b in right if a[0] == b[0] and met(a, b))


@pytest.mark.parametrize("widths", [WIDTHS, (4,), (2, 8, 32)])
def test_equals_comparing_all(spark, widths):
    r = random.Random(1)
    span = lambda k: (s := r.randint(0, 300), s + r.choice([0, 1, 2, 5, 30, 64, 65, 200, 5_000]), k)
    left = [(r.choice(["a", "b", None]), *span(n)) for n in range(120)] + [("a", None, 4, 0), ("b", 4, None, 1), ("a", 3, 9, 7), ("a", 3, 9, 7)]
    right = [(r.choice(["a", "b", None]), *span(n)) for n in range(120)] + [("a", 5, 5, 0), ("a", 5, 5, 0), ("b", None, None, 1)]
    one = spark.createDataFrame(left, "id string, s bigint, e bigint, k int")
    two = spark.createDataFrame(right, "id string, s2 bigint, e2 bigint, k2 int").repartition(3)
    joined = overlapping(one, two, ["id"], ("s", "e"), ("s2", "e2"), widths)
    assert joined.columns == ["id", "s", "e", "k", "s2", "e2", "k2"]
    assert sorted(map(tuple, joined.collect())) == brute(left, right)
    assert overlapping(one.limit(0), two, ["id"], ("s", "e"), ("s2", "e2"), widths).count() == 0


def test_few_copies_and_no_nested_loop(spark):
    one = spark.range(1).select(F.lit("a").alias("id"), F.lit(0).cast("bigint").alias("s"), F.lit(10**9).cast("bigint").alias("e"))
    two = spark.range(200_000).select(F.lit("a").alias("id"), (F.col("id") * 100).alias("s2"), (F.col("id") * 100 + 5).alias("e2"))
    joined = overlapping(one, two, ["id"], ("s", "e"), ("s2", "e2"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and joined.count() == 200_000


def test_columns_of_one_name_are_an_error(spark):
    df = spark.createDataFrame([("a", 1, 2)], "id string, s int, e int")
    with pytest.raises(ValueError, match="both sides have e, s"):
        overlapping(df, df, ["id"], ("s", "e"), ("s", "e"))


def test_lines(spark):
    texts = ["", None, "a", "a\n", "\n\nb😀\nc", "\n", "x" * 100_000 + "\n" + "\n".join("y" * 30_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", line_spans(F.col("text")).alias("lines")).collect()
    for n, found in rows:
        expected, at = [], 0
        for k, line in enumerate((texts[n] or "").split("\n")[: None if texts[n] and not texts[n].endswith("\n") else -1]):
            end = min(at + len(line) + 1, len(texts[n]))
            expected.append((k + 1, at, end))
            at = end
        assert [tuple(x) for x in found] == expected
