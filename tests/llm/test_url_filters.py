import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import url_filters


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fit, default=(0, 0, None, default))
    return host, path, rule, verdict


def random_url(r):
    labels = [r.choice(["a", "b", "www", "com", "net", "Ä", "x1", ""]) for _ in range(r.randint(0, 5))]
    path = "".join(r.choice(["/", "en", "es", "/é", "x", "😀"]) for _ in range(r.randint(0, 5)))
    return r.choice(["http://", "HTTPS://", "", "x", "://", "a://b://"]) + ".".join(labels).upper() + ("/" + path if r.random() < 0.8 else "") + r.choice(["", "?q=/en", "#/es", "?u=http://a.com/en"])


RULES = [("com", "/", "allow"), ("a.com", "/en", "block"), ("www.a.com", "", "allow"), ("net", "/es", "block"), ("b", "", "block"), ("b.net", "/é", "allow"), ("Ä.com", "/x", "block"), ("x1.b.net", "/", "block"), ("com", "/enx", "block")]


@pytest.mark.parametrize(("filter_bytes", "last_keys"), [(1 << 20, 50_000), (1 << 20, 0), (0, 0)])
def test_verdicts_equal_every_rule_tried(spark, filter_bytes, last_keys):
    r = random.Random(5)
    rules = RULES + [(f"h{i}.net", f"/p{i % 7}", r.choice(["block", "allow"])) for i in range(300)]
    urls = [random_url(r) for _ in range(700)] + [f"http://w.h{i}.net/p{i % 5}/x" for i in range(600)] + [None, "", "http://", "http://com", "http://COM/", "http://com./", "http://.com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    found = url_filters.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "review", filter_bytes=filter_bytes, last_keys=last_keys).collect()
    expected = {i: brute(u, rules, "review") for i, u in enumerate(urls)}
    assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in found} == expected
    assert len(found) == len(urls)


@pytest.mark.parametrize("last_keys", [0, 500, 100_000])
def test_a_cascade_is_exact_for_its_whole_universe(spark, last_keys):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    wanted = spark.range(0, 40_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))  # half of them not in the universe
    hashed = url_filters._hashed(universe)
    levels = url_filters.build_cascade(hashed, wanted, last_keys)
    rows = hashed.collect()
    keys = np.array([(x["h1"], x["h2"]) for x in rows], np.int64).view(np.uint64)
    assert len(levels) > 2
    assert [bool(x) for x in url_filters.listed(levels, keys)] == [int(x["key"][1:]) % 7 == 0 for x in rows]


def test_edges(spark):
    rules = spark.createDataFrame([("a.com", "/", "block"), ("a.com", "/", "allow"), ("", "/", "block"), ("b.com", None, "block")], "host string, path string, verdict string")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(empty, rules).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert url_filters.judge_urls(empty, rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/", 3, "v"), (1, "http://a.com/", 3, "v"), (None, "http://" + "a." * 50_000 + "b.com/" + "/x" * 100_000, 4, "v"), (2, "http://c.com", 5, "v")], "page_id long, url string, _keys int, verdict string")
    rows = url_filters.judge_urls(pages, rules).collect()
    assert sorted((x["_keys"], x["rule"], x["verdict"]) for x in rows if x["rule"]) == [(3, "a.com/", "block"), (3, "a.com/", "block"), (4, "b.com", "block")]
    assert [x["verdict"] for x in rows if x["rule"] is None] == ["allow"]
    assert url_filters.judge_urls(pages, rules.where("false"), "block").select("verdict").distinct().collect()[0][0] == "block"


def test_no_join_touches_the_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    plan = url_filters.judge_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
