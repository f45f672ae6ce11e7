import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.functions import dialect
from sieveline.operators import catalogue
from sieveline.operators import scan as scans
from sieveline.operators.decide import decide
from sieveline.operators.scan import scan
from sieveline.sources.rules import Rule, hashed_rule

PATTERNS = ["ab+", "a|b", "(?i)aB", "(?i:ab)c", r"\bca\b", "[a-c]{2}", "abc", "é", "(ab)+c", "b(?=a)", "c$", r"\w+@\w+\.com"]


def test_equals_the_scan_of_each_rule(spark):
    r = random.Random(3)
    rules = [Rule(f"p{n}", p, action=r.choice(["block", "redact", "warn"]), target=r.choice(["both", "llm", "tool"]), tool=r.choice([None, None, "Bash"])) for n, p in enumerate(PATTERNS)]
    rules += [Rule(f"l{n}", x, is_regex=False, replacement=r.choice([None, "ip", "R"])) for n, x in enumerate(["aa", "a.b", "ca", "😀", "aba", "a"])]
    rules += [hashed_rule(x, f"h{x}", hash_extractor=e) for x, e in (("abc", r"\w+"), ("ca", r"\w+"), ("ab", "[ab]+"))] + [Rule("path", path_pattern="*"), Rule("no", "0" * 64, hashed=True)]
    r.shuffle(rules)
    texts = ["".join(r.choice(["a", "b", "c", "A", "é", "😀", " ", ".", "@x.com", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(n, t, r.choice(["llm", "tool"]), r.choice(["Bash", "Read", None])) for n, t in enumerate(texts)], "id int, text string, channel string, tool string").repartition(3)
    one, other = (f(df, rules, channel=F.col("channel"), tool=F.col("tool")).select("id", "matches").orderBy("id").collect() for f in (scan, catalogue.scan_catalogue))
    assert one == other
    assert scan(df, rules).orderBy("id").collect() == catalogue.scan_catalogue(df, rules).orderBy("id").collect()


def test_parts_of_a_large_catalogue(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "PART_CHARACTERS", 10)  # read on the driver
    rules = [Rule(f"r{n}", f"w{n} ", is_regex=False, action="warn") for n in range(20)]
    df = spark.createDataFrame([(" ".join(f"w{n}" for n in range(25)),)], "text string")
    assert [m.rule_id for m in catalogue.scan_catalogue(df, rules).first().matches] == [f"r{n}" for n in range(20)]


def test_the_plan_is_the_same_for_any_number_of_rules(spark):
    df = spark.createDataFrame([("secret-4711 and token-42x",)], "text string")
    sizes = []
    for n in (10, 5_000):
        rules = [Rule(f"r{i}", f"secret-{i}[0-9]*" if i % 2 else f"token-{i}x", is_regex=bool(i % 2)) for i in range(n)]
        began = time.time()
        made = decide(catalogue.scan_catalogue(df, rules))
        sizes.append(len(made._jdf.queryExecution().optimizedPlan().toString()))
        found = made.first()
        assert time.time() - began < 30
    assert abs(sizes[0] - sizes[1]) < 50 and found.block_reasons
    expected = [i for i in range(5_000) if (re.search(f"secret-{i}[0-9]*", "secret-4711") if i % 2 else i == 42)]
    assert [m.rule_id for m in found.matches] == [f"r{i}" for i in expected]


def test_matches_leave_python_in_bounded_pieces(spark):
    """A batch of rows with many matches doesn't become one array."""
    made = list(scans.in_pieces(iter([[(n, str(n))] * 7_000 for n in range(30)] + [[]] * 25_000), {"a": pa.int32(), "b": pa.string()}))
    assert max(len(x.values) for x in made) < scans.HELD + 7_000 and max(map(len, made)) <= scans.HELD_ROWS
    assert sum((x.to_pylist() for x in made), []) == [[{"a": n, "b": str(n)}] * 7_000 for n in range(30)] + [[]] * 25_000
    df = spark.createDataFrame([(n, "ab " * 20_000 if n % 2 else None) for n in range(12)], "id int, text string").repartition(1)
    found = catalogue.scan_catalogue(df, [Rule("a", "ab", is_regex=False), Rule("b", "b .")]).select("id", F.size("matches").alias("n"), F.get("matches", F.lit(39_998))["end"].alias("last"))
    assert sorted(found.collect()) == [(n, 39_999 if n % 2 else 0, 59_998 if n % 2 else None) for n in range(12)]


def test_errors_and_needs(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(ValueError, match="share an id"):
        catalogue.scan_catalogue(df, [Rule("a", "x"), Rule("a", "y")])
    with pytest.raises(ValueError, match="match nothing"):
        catalogue.scan_catalogue(df, [Rule("a", "x*")])
    assert dialect.needed("(?i:abc)d") == "d" and dialect.matches_nothing("a*") and not dialect.matches_nothing("a")
    assert catalogue.scan_catalogue(df, []).first().matches == []
