import random
import re
from collections import Counter
from math import floor, log
from zlib import crc32

import numpy as np
import pytest

from sieveline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + g]) for g in range(1, longest + 1) for i in range(len(words) - g + 1)]


def brute(texts, target, longest, buckets):
    of = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in side for f in features(x, longest)[1]) for side in (texts, target))
    gain = lambda b: floor(1000 * log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for x in texts:
        words, made = features(x, longest)
        out.append((len(words), len(made), sum(gain(of(f)) for f in made) // len(made) if made else 0))
    return out


def random_text(r):
    if r.random() < 0.1:
        return r.choice([None, "", " .,; ", "a", "Ä\x7fÄ", "x" * 300])
    return "".join(r.choice(["to", "be", "or", "NOT", "é😀", "7a", "That"]) + r.choice([" ", ", ", "\n", "-", "　", " "]) for _ in range(r.randint(1, 80)))


@pytest.mark.parametrize(("longest", "block_words", "section"), [(1, 1 << 20, 1 << 22), (2, 1 << 20, 1 << 22), (2, 50, 20), (3, 30, 7), (5, 1 << 20, 1 << 22), (5, 1, 1)])
def test_weights_equal_counting_every_feature(spark, longest, block_words, section):
    r = random.Random(longest)
    texts, target = [random_text(r) for _ in range(120)], [random_text(r) for _ in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(x,) for x in target], "text string")
    found = {x["doc_id"]: (x["n_words"], x["n_features"], x["weight"]) for x in resampling.weigh(docs, items, longest, 97, block_words=block_words, section=section).collect()}
    assert found == dict(enumerate(brute(texts, target, longest, 97)))


def test_equal_ngrams_are_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(resampling, "crc32", lambda *a: calls.append(a) or crc32(*a))
    words = b"a b a b a b c".split() * 50
    found = resampling.block_buckets(words, np.array([len(words)]), np.array([0]), 2, 10_000)
    assert len(calls) == 3 + 2 * 4  # a, b, c; ab, ba, bc, ca, each with its space
    assert found[1][:2].tolist() == [crc32(b"a b") % 10_000, crc32(b"b a") % 10_000]


def test_ranks(spark):
    rows = [(n, 20 + n % 3, 5, 0, n % 11) for n in range(400)] + [(1000, 19, 5, 0, 99), (7, 30, 5, 0, 7), (None, 40, 5, 0, 10)]
    made = resampling.draw(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7), 25, 20).collect()
    fit = sorted((x for x in made if x["n_words"] >= 20), key=lambda x: (-x["score"], x["doc_id"] is None, x["doc_id"] or 0))
    assert len(made) == len(rows)
    drawn = [x for x in fit if x["rank"]]
    assert [x["rank"] for x in drawn] == list(range(1, 25 * len(fit) // 100 + 1))
    assert drawn == fit[: len(drawn)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], "doc_id long, text string, rank string")
    none = docs.where("false").select("doc_id", "text")
    rows = resampling.draw(resampling.weigh(docs, none), 100, 1).collect()
    assert sorted((x["doc_id"] or 0, x["n_features"], x["rank"] or 0) for x in rows) == [(0, 0, 0), (1, 3, 1), (1, 3, 2)]
    assert resampling.resampled_ranks(none, docs).count() == 0
    kept = resampling.resample(docs, docs, 100, 1)
    assert kept.columns == docs.columns and kept.count() == 2
