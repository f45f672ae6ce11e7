import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sieveline.llm import simhash
from sieveline.llm.common import materialize
from sieveline.llm.components import components


def brute_fingerprint(text, shingle=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keys, linked):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def near(fps):
    return brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def clusters(seed, n, around, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        center = rng.getrandbits(64)
        for _ in range(around):
            x = center
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_trie_links_tie_what_is_near():
    for seed in range(5):
        fps = clusters(seed, 10, 15, 5)
        pairs = {f: f for f in fps}
        for masks in ([0], simhash._masks(4, 3), simhash._masks(8, 3)):
            links = [simhash.trie_links(np.array(fps, np.uint64), mask, 3) for mask in masks]
            both = {(x, y) for a, b in links for x, y in zip(a.tolist(), b.tolist(), strict=True)}
            assert brute_groups(list(pairs), lambda a, b: (a, b) in both) == near(fps)


def test_every_close_pair_agrees_on_one_choice_of_runs():
    rng = random.Random(2)
    for parts in (4, 8, 12):
        masks = simhash._masks(parts, 3)
        assert len(set(masks)) == len(masks) and all(m.bit_count() >= 64 * (parts - 3) // parts - 3 for m in masks)
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not apart & m for m in masks)


def test_a_cluster_of_many_fingerprints_takes_bounded_work(spark):
    rng = np.random.default_rng(4)
    fps = np.full(40_000, np.uint64(rng.integers(1 << 63)))
    for _ in range(6):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    fps = np.unique(fps)
    a, b = simhash.trie_links(fps, 0, 3)
    expected = sorted(map(tuple, zip(a.tolist(), b.tolist(), strict=True)))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = materialize(simhash.links(df))
    assert found.count() < 20 * len(fps)
    roots = {r.node % (1 << 64): r.root for r in components(found).collect()}
    assert all(roots[x] == roots[y] for x, y in expected) and len(set(roots.values())) == len({y for _, y in expected} - {x for x, _ in expected})


def test_crowded_groups_are_dealt_out_again(spark):
    fps = clusters(7, 3, 60, 5)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), group=5).collect()}
    assert brute_groups(fps, lambda a, b: (a, b) in links) == near(fps)
    again = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), group=5, chunk=10).collect()}
    assert brute_groups(fps, lambda a, b: (a, b) in again) == near(fps)


def test_repeated_rows_are_one_fingerprint():
    fps = np.array([0, 0, 1 << 20, 1 << 20, (1 << 40) - 1, (1 << 40) - 1, (1 << 40) - 2], np.uint64)
    links = set(zip(*(v.tolist() for v in simhash.trie_links(fps, 0, 3)), strict=True))
    assert brute_groups(sorted(set(fps.tolist())), lambda a, b: (a, b) in links) == near(sorted(set(fps.tolist())))
    assert all((a ^ b).bit_count() <= 3 for a, b in links)


def test_a_family_that_shares_many_bits_is_dealt_out_often(spark):
    rng = random.Random(3)
    shared, fps = rng.getrandbits(40), set()
    for _ in range(12):
        center = rng.getrandbits(24)
        fps |= {shared | (center ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 1)))) << 40 for _ in range(8)}
    fps = sorted(fps)
    assert 1 < len(set(near(fps).values())) < len(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    rows = simhash.links(spark.createDataFrame(signed, "fp long"), group=5).collect()
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in rows}
    assert brute_groups(fps, lambda a, b: (a, b) in links) == near(fps)


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 1999), (1999, 2000), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for n in range(30):
        text = rng.choices(words, k=rng.randint(1, 400))
        for _ in range(rng.randint(1, 3)):
            copy = list(text)
            copy[rng.randrange(len(copy))] = "CHANGED"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (903, "one"), (None, "one"), (None, "alone here"), (905, "x " * 20_000)]
    return spark.createDataFrame([(a, b, "s", 1) for a, b in rows], "doc_id long, text string, fp string, root int")


def test_against_brute_force(spark):
    df = documents(spark)
    rows = df.collect()
    fps = {r.text: brute_fingerprint(r.text) for r in rows}
    groups = near(sorted(set(fps.values())))
    least: dict = {}
    for r in rows:
        if r.doc_id is not None:
            g = groups[fps[r.text]]
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expected = [(r.doc_id, f"{fps[r.text]:016x}", least.get(groups[fps[r.text]])) for r in rows]
    found = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def similarity(a, b):
    a, b = (set(simhash._shingles((t or "").encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, text, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("group", [2_000, 20])
def test_one_row_of_each_group_stays(spark, group):
    """Near copies of similarity 0.8 and more against brute force; also where groups are crowded and rows come in small chunks."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(3000)]
    rows = []
    for n in range(150):
        base = " ".join(rng.choices(words, k=rng.randint(30, 500)))
        rows.append((10 * n, base))
        rows += [(10 * n + k, edited(rng, words, base, rng.uniform(0, 0.03))) for k in range(1, 3)]
    family = " ".join(rng.choices(words, k=300))
    rows += [(5_000 + n, edited(rng, words, family, 0.01)) for n in range(200)]
    rows += [(9_000, None), (9_001, ""), (9_002, " \n\t"), (9_003, "one"), (9_004, "ONE"), (9_003, "one"), (None, "one"), (None, "alone here"), (9_005, "x " * 20_000)]
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], "doc_id long, text string, _id string, root int")
    kept = simhash.drop_near_duplicates(df, group=group, chunk=50 * group)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x and x >= 9_000) == [9_000, 9_003, 9_005] and left.count(None) == 1
    texts = dict(rows)
    sets = {n: set(simhash._shingles(texts[n].encode(), 5)) for n in range(5_000, 5_200)}
    family = brute_groups(list(sets), lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    of_family = [x for x in left if x in sets]
    # no wrong link: of each exact component a row stays at least
    assert set(family.values()) <= {family[x] for x in of_family} and len(of_family) <= len(set(family.values())) + 3 < 20
    alike = [10 * n + k for n in range(150) for k in (1, 2) if similarity(texts[10 * n], texts[10 * n + k]) >= 0.8]
    assert len(alike) > 100 and len(set(alike) & set(left)) <= 0.1 * len(alike)
    unlike = [10 * n + k for n in range(150) for k in (1, 2) if max(similarity(texts[10 * n + k], texts[10 * n + j]) for j in (0, 1, 2) if j != k) < 0.8]
    assert unlike and set(unlike) <= set(left)
    assert {10 * n for n in range(150)} <= set(left)


@pytest.mark.parametrize("group", [2_000, 50])
def test_templates_are_no_duplicates(spark, group):
    """Texts of one template, 0.59 alike in pairs, all stay; twins among them go."""
    rng = random.Random(11)
    template = [f"t{n}" for n in range(120)]
    texts = [" ".join(template + [f"w{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(600)]
    assert 0.5 < similarity(texts[0], texts[1]) < 0.65
    twins = [t.replace("t7 ", f"x{n} ") for n, t in enumerate(texts[:40])]
    assert all(similarity(a, b) >= 0.8 for a, b in zip(texts, twins, strict=False))
    df = spark.createDataFrame(list(enumerate(texts + twins)), "doc_id long, text string").repartition(4)
    left = {r.doc_id for r in simhash.drop_near_duplicates(df, group=group, chunk=200).collect()}
    assert set(range(600)) <= left and len(left & set(range(600, 640))) <= 4


def test_pairs_are_asked_for_until_they_are_tied():
    rng = np.random.default_rng(6)
    n = 60
    group = rng.integers(0, 6, n)
    a, b = (x.astype(np.int64) for x in np.triu_indices(n, 1))
    asked = []

    def alike(x, y):
        asked.append(len(x))
        return (group[x] == group[y]) & ((x + y) % 3 == 0)

    labels = simhash._tied_if(np.arange(n), a, b, alike)
    expected = brute_groups(range(n), lambda x, y: group[x] == group[y] and (x + y) % 3 == 0)
    assert labels.tolist() == [expected[x] for x in range(n)]
    same = simhash._Similar([np.arange(9), np.arange(8), np.arange(1, 9), np.arange(0), np.arange(0)])
    assert same(np.array([0, 1, 0, 3, 0]), np.array([1, 2, 2, 4, 3])).tolist() == [True, False, True, True, False]


@pytest.mark.parametrize(("group", "n"), [(2_000, 400), (10, 400), (10, 12)])
@pytest.mark.parametrize("with_sets", [False, True])
def test_no_pair_of_a_group_is_left_out(spark, group, n, with_sets):
    """All rows agree on all least hashes that make the groups; pairs of fingerprints differ anywhere. Also where the group is crowded and cut, and where tasks and chunks end."""
    rng = random.Random(n + group)
    fps = [rng.getrandbits(256) for _ in range(n // 2)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(256), rng.randint(40, 52))) for f in fps[: n // 3]]
    sets = [np.arange(20 * (k % (n // 2)), 20 * (k % (n // 2)) + 20) + (np.arange(20) % 4 == 0) * (10**6 + k) * (k % 3 == 0) for k in range(len(fps))]
    rows = [(f.to_bytes(32, "big"), np.array([7, 8, 9, 10, *(rng.getrandbits(32) for _ in range(8))], "<u4").tobytes(), np.sort(s).astype("<u8").tobytes()) for f, s in zip(fps, sets, strict=True)]
    df = spark.createDataFrame(rows, "fp binary, least binary, set binary").repartition(3)
    links = simhash.wide_links(df if with_sets else df.drop("set"), 4, 1, group=group, chunk=5 * group).collect()
    known = dict(zip(fps, map(set, (s.tolist() for s in sets)), strict=True))
    near = lambda a, b: (a ^ b).bit_count() <= 52 and (not with_sets or 10 * len(known[a] & known[b]) >= 8 * len(known[a] | known[b]))
    expected = brute_groups(fps, near)
    assert n // 9 <= len(fps) - len(set(expected.values())) <= n // 3 + 1
    linked = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in links}
    assert brute_groups(fps, lambda a, b: (a, b) in linked) == expected


def test_choices_grow_slowly_with_the_number_of_rows():
    assert simhash.choices(2) == simhash.choices(1 << 20) == (4, 11)
    for n in (1, 1 << 20, 1 << 30, 5 * 10**10):
        agreed, turns = simhash.choices(n)
        assert (1 - simhash.SIMILAR**agreed) ** turns <= simhash.MISSED and n <= 16 << 4 * agreed and turns <= 30


def test_least_hashes_agree_as_often_as_sets_are_similar():
    rng = random.Random(8)
    words = [f"w{n}" for n in range(5000)]
    agree, bits, expected = [], [], []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(100, 6000))
        at = rng.randrange(len(base))
        other = base[: max(50, at)]
        (a, x), (b, y) = (simhash.wide_fingerprint(" ".join(t).encode(), 5, 200) for t in (base, other))
        agree.append(np.mean(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")))
        bits.append((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / 256)
        expected.append(similarity(" ".join(base), " ".join(other)))
    expected = np.array(expected)
    assert np.abs(np.array(agree) - expected).max() < 0.15 and abs(np.mean(agree) - expected.mean()) < 0.02
    assert np.abs(np.array(bits) - np.arccos(2 * expected / (1 + expected)) / np.pi).mean() < 0.2
    assert simhash.wide_fingerprint(b"", 5, 3) == (bytes(32), b"\xff" * 12)


def test_empty(spark):
    empty = documents(spark).limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
