import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    part = {}
    for vec_id, x, label in sorted((r for r in rows if None not in r and all(v is not None and isfinite(v) for v in r[1])), key=lambda r: (r[0], r[2], [floor(256 * v) for v in r[1]])):
        part.setdefault(vec_id, (label, [floor(256 * v) for v in x]))
    out = set()
    for a, (label, q) in part.items():
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, y)), v, lab) for v, (lab, y) in part.items() if v != a)
        for s, v, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(t, w) for t, w, lab in scored if lab != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out |= {(a, v, n + 1, w, -s, -t) for n, (t, w) in enumerate(fit)}
    return out


def found(spark, rows, every, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    made = [tuple(r) for r in hn.hard_negatives(hn.prepare(df), F.col("vec_id") % every == 0, **how).collect()]
    assert len(made) == len(set(made))
    return set(made)


def vectors(seed, n, width, ties=False):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = r.randrange(4)
        x = [float(r.randint(-1, 1)) for _ in range(width)] if ties else [c + r.gauss(0, 0.8) for c in centres[label]]
        rows.append((i, x, label))
    return rows


@pytest.mark.parametrize(("width", "ties", "small"), [(16, False, False), (16, False, True), (3, True, True), (1, True, False)])
def test_equals_all_products(spark, monkeypatch, width, ties, small):
    if small:  # read on the driver: how many cells there are
        monkeypatch.setattr(hn, "ANCHORS", 7)
        monkeypatch.setattr(hn, "FEWEST_ROWS", 50)
    rows = vectors(width, 400, width, ties)
    rows += [(1000, None, 1), (1050, [1.0] * width, None), (None, [1.0] * width, 1), (1100, [float("nan")] * width, 1), (1150, [float("inf")] * width, 2), (1200, [None] * width, 2), (20, rows[7][1], 3), (20, *rows[20][1:])]
    rows += [(2000 + i, rows[3][1], i % 4) for i in range(60)]  # a common vector
    rows += [(3000, rows[0][1][: width // 2], 0)]  # a shorter one
    assert found(spark, rows, 20) == brute(rows, 20)


def test_other_numbers_and_large_components(spark):
    rows = [(i, [v * 1e5 for v in x], label) for i, x, label in vectors(9, 150, 8)]
    assert found(spark, rows, 10, positives=2, negatives=4, low=20, high=80) == brute(rows, 10, 2, 4, 20, 80)


def test_edges(spark):
    assert found(spark, [], 5) == set()
    assert found(spark, [(1, [1.0], 1)], 5) == set()
    assert found(spark, [(5, [], 1), (6, [], 1), (7, [], 2)], 5) == {(5, 6, 1, 7, 0, 0)}
    assert found(spark, [(5, [1e12], 1), (6, [1.0], 1), (7, [1.0], 2)], 1) == set()  # the first is too long, the others alike


def test_no_pair_within_bounds_is_discarded():
    r = np.random.default_rng(3)
    q = r.integers(-500, 500, (300, 24)) * np.geomspace(40, 1, 24).astype(int)
    turn = np.linalg.eigh(q.T @ q)[1][:, ::-1]
    cuts = [3, 6, 12]
    side = hn._Side(np.arange(300), r.integers(0, 3, 300), q, turn, cuts)
    score = q @ q.T
    least = np.sort(score, 1)[:, -9].astype(float)
    i, j, exact = hn.survivors(side, side, cuts, least, np.full(300, np.inf), False, 1e-12)
    assert {*zip(i.tolist(), j.tolist())} >= {*zip(*(x.tolist() for x in np.nonzero(score >= least[:, None])))}
    assert (exact == score[i, j]).all() and len(i) < 300 * 300 / 4
