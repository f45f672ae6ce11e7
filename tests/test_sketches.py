import random

from sieveline.operators.sketches import read_days, sketched, standard_error, summed, write_day

BY = ["lang", "rule"]


def exact(rows, sets):
    out = {}
    for lang, rule, value in rows:
        for level in sets:
            at = (None if level & 2 else lang, None if level & 1 else rule, level)
            n, values = out.setdefault(at, [0, set()])
            if value is not None:
                out[at][0] = n + 1
                values.add(value)
    return {at: (n, len(values)) for at, (n, values) in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, rule string, value string").repartition(5)


def test_a_cube_is_within_its_error(spark):
    r = random.Random(2)
    rows = [(r.choice(["en", "en", "en", "de", None]), r.choice("xyz"), r.choice([f"v{r.randint(0, 30_000)}", "often", None])) for _ in range(40_000)]
    rows += [("fr", "x", None)] * 3
    got = {(x.lang, x.rule, x.level): (x.n, x.n_values) for x in summed(sketched(table(spark, rows), BY, "value"), BY).collect()}
    expected = exact(rows, range(4))
    assert got.keys() == expected.keys()
    for at, (n, values) in expected.items():
        assert got[at][0] == n and abs(got[at][1] - values) <= 5 * standard_error() * values
    assert got["fr", "x", 0] == (0, 0)


def test_days_merge_and_a_day_is_replaced(spark, tmp_path):
    days = {f"2024-01-0{d}": [("en", "x", f"v{n}") for n in range(100 * d, 100 * d + 300)] for d in range(1, 5)}
    for day, rows in days.items():
        for part in (rows[:10], rows):  # the second run of a day replaces the first
            write_day(sketched(table(spark, part), BY, "value"), str(tmp_path), day)
    whole = summed(read_days(spark, str(tmp_path)), BY, [BY]).collect()
    assert [(x.lang, x.rule, x.level, x.n) for x in whole] == [("en", "x", 0, 1200)] and abs(whole[0].n_values - 600) <= 5 * standard_error() * 600
    some = summed(read_days(spark, str(tmp_path), "2024-01-02", "2024-01-03"), BY, [["lang"]]).first()
    assert (some.lang, some.rule, some.level, some.n) == ("en", None, 1, 600) and abs(some.n_values - 400) <= 5 * standard_error() * 400


def test_values_are_not_shuffled(spark):
    plan = summed(sketched(table(spark, [("en", "x", "v")]), BY, "value"), BY)._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "Generate" not in plan
    assert summed(sketched(table(spark, []), BY, "value"), BY, [BY]).count() == 0
