import hashlib
import random
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from sieveline.functions.spans import running
from sieveline.operators import vault
from sieveline.operators.decide import decide, redact, splice
from sieveline.operators.scan import scan
from sieveline.sources.rules import Rule


def run(spark, rules, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return decide(scan(df, rules, **options)).orderBy("id").collect()


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_replacements(spark):
    rules = [Rule("l", "password", action="redact", replacement="***"), Rule("d", "nothing", action="redact"), Rule("i", "IP", action="redact", replacement="ip"), Rule("e", "EM", action="redact", replacement="email"), Rule("h", "HO", action="redact", replacement="hostname"), Rule("s", "ST", action="redact", replacement="str"), Rule("o", "gone", action="redact", replacement="")]
    row = run(spark, rules, "the password is nothing IP EM HO ST gone!")[0]
    h = bytes.fromhex(short("IP"))
    assert row.redacted_text == f"the *** is [REDACTED] 10.{h[0]}.{h[1]}.{h[2]} redacted-{short('EM')[:8]}@example.com host-{short('HO')[:8]}.internal str !"
    assert row.decision == "redact" and row.redact_ids == "l, d, i, e, h, s, o"


def test_block_comes_first_and_keeps_warnings(spark):
    rules = [Rule("r", "a", action="redact"), Rule("b", "b"), Rule("w", "c", action="warn", description="careful")]
    rows = run(spark, rules, "a bb c", "c a", "c", "x", None)
    assert [r.decision for r in rows] == ["block", "redact", "warn", "allow", "allow"]
    assert rows[0].block_reasons == ["[b] Pattern matched"] * 2 and rows[0].warn_reasons == ["[w] careful"] and rows[0].redacted_text is None
    assert rows[2].redacted_text == "c" and rows[4].redacted_text is None


def test_unknown_actions_redact(spark):
    assert run(spark, [Rule("z", "a", action="zap")], "a!")[0].redacted_text == "[REDACTED]!"


def test_overlapping_spans_use_the_first_offsets(spark):
    ms = "array(named_struct('start',0,'end',6,'by','XX'), named_struct('start',2,'end',9,'by','YYYYY'), named_struct('start',2,'end',4,'by','Z'))"
    df = spark.sql(f"select 'abcdefghij' text, {ms} ms")
    assert df.select(splice(F.col("text"), F.col("ms"), lambda m: m["by"])).first()[0] == "XXj"


def test_offsets_are_code_points(spark):
    assert run(spark, [Rule("a", "b+", action="redact", replacement="é")], "😀bb😀b")[0].redacted_text == "😀é😀é"


def test_redact_rewrites_the_column_only(spark):
    df = spark.createDataFrame([(1, "see alice@example.com or bob@example.com", "x")], "id int, text string, matches_ string")
    out = redact(df, [Rule("e", r"[a-z]+@example\.com", action="redact", replacement="[EMAIL]")])
    assert out.first().text == "see [EMAIL] or [EMAIL]" and out.columns == ["id", "text", "matches_", "decision"]


def test_values_keep_their_first_replacement(spark, tmp_path):
    path = str(tmp_path / "vault")
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, text string")
    first = scan(df, [Rule("r", "[ab]", action="redact", replacement="1")])
    vault.append(first, path)
    vault.append(first, path)
    assert sorted(tuple(r) for r in vault.read(spark, path).collect()) == [("r", "a", "1"), ("r", "b", "1")]
    later = scan(spark.createDataFrame([(1, "a c")], "id int, text string"), [Rule("r", "[abc]", action="redact", replacement="2")])
    kept = vault.read(spark, path)
    assert sorted(tuple(r) for r in vault.resolve(later, kept).collect()) == [("r", "a", "1"), ("r", "c", "2")]
    assert [tuple(r) for r in vault.new_values(later, kept).collect()] == [("r", "c", "2")]
    assert decide(vault.with_known(later, kept), known="known").first().redacted_text == "1 2"


@pytest.mark.parametrize("most", [0, 10])
@pytest.mark.parametrize("store", ["plain", "hash"])
def test_kept_replacements_are_found_however_originals_are_stored(spark, tmp_path, monkeypatch, store, most):
    monkeypatch.setattr(vault, "BROADCAST_MAPS", most)
    path = str(tmp_path / "vault")
    vault.append(scan(spark.createDataFrame([(1, "a b a")], "id int, text string"), [Rule("r", "[ab]", action="redact", replacement="1")]), path, store=store)
    twice = vault.read(spark, path).union(spark.createDataFrame([("r", "a" if store == "plain" else short("a"), "9")], vault.SCHEMA))
    rows = [(1, "a c", "x"), (2, "nothing", "x"), (3, "a c", "y"), (4, None, "x"), (5, "c", "x")]
    later = scan(spark.createDataFrame(rows, "id int, text string, known string"), [Rule("r", "[abc]", action="redact", replacement="2")])
    out = decide(vault.with_known(later, twice, store=store, out="kept"), known="kept").orderBy("id").collect()
    assert [r.redacted_text for r in out] == ["1 2", "nothing", "1 2", None, "2"] and [r.known for r in out] == ["x", "x", "y", "x", "x"]
    assert sorted(tuple(r) for r in vault.resolve(later, twice, store=store).collect()) == [("r", "a", "1"), ("r", "c", "2")]
    assert [r.replacement for r in vault.new_values(later, twice, store=store).collect()] == ["2"]
    assert vault.vault_path("/x/", "p") == "/x/p" and vault.vault_path("/x") == "/x/global"


def test_many_spans_are_spliced_in_one_go(spark):
    text = "\ufeff😀ab " * 30_000
    row = run(spark, [Rule("r", "a", action="redact", replacement="\ufeff!"), Rule("s", " ", action="redact", replacement="")], text)[0]
    assert row.redacted_text == "\ufeff😀\ufeff!b" * 30_000


def test_vault_as_json(spark):
    table = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("s", "a", "3")], vault.SCHEMA)
    text = vault.export_json(table)
    assert sorted(r.json for r in text.collect())[0] == '{"mappings":{"r":{"a":"1"}}}'
    assert sorted(map(tuple, vault.import_json(text).collect())) == sorted(map(tuple, table.collect()))
    whole = spark.createDataFrame([('{"mappings":{"r":{"a":"1","b":"2"},"s":{"a":"3"}}}',)], "json string")
    assert sorted(map(tuple, vault.import_json(whole).collect())) == sorted(map(tuple, table.collect()))
    assert vault.import_json(spark.createDataFrame([("not json",), ("[]",)], "json string")).count() == 0


def test_blocked_rows_and_hashed_storage(spark, tmp_path):
    rules = [Rule("r", "a", action="redact"), Rule("b", "z")]
    df = scan(spark.createDataFrame([("a z",)], "text string"), rules)
    assert vault.values(df).count() == 0
    vault.append(scan(spark.createDataFrame([("a",)], "text string"), rules), str(tmp_path / "v"), store="hash")
    assert vault.read(spark, str(tmp_path / "v")).first().original == short("a")


def turn_by_turn(text, found):
    for _, _, start, end, by in sorted((-s, i, s, e, b) for i, (s, e, b) in enumerate(found)):
        text = text[:start] + by + text[end:]
    return text


def test_overlapping_spans_equal_the_fold(spark):
    r = random.Random(4)
    rows = []
    for n in range(500):
        text = "".join(r.choice("abcdeé😀﻿") for _ in range(r.randint(0, 30)))
        found = []
        for _ in range(r.randint(1, 12)):
            start = r.randint(0, len(text))
            found.append((start, min(start + r.randint(1, 9), len(text) + r.choice([0, 0, 0, 5])), r.choice(["", "X", "YYYY", "😀Z", "Q" * 12])))
        if r.random() < 0.2:
            found.append((0, r.randint(0, 40), "P"))  # a path's match, longer than the text
        rows.append((n, text, [f for f in found if f[0] <= f[1]] or [(0, 0, "")]))
    df = spark.createDataFrame(rows, "id int, text string, found array<struct<start:int,end:int,by:string>>").repartition(4)
    made = {x.id: (x.out, x.text, x.found) for x in df.withColumn("out", splice(F.col("text"), F.col("found"), lambda m: m["by"])).collect()}
    for out, text, found in made.values():
        assert out == turn_by_turn(text, found), (text, found)


def test_many_overlapping_spans_take_seconds(spark):
    n = 20_000
    spans = f"transform(sequence(0, {n - 1}), i -> struct(i * 3 AS start, i * 3 + 5 AS end, concat('<', i, '>') AS by))"
    df = spark.sql(f"SELECT repeat('abc', {n}) AS text, {spans} AS found")
    splice_of = lambda text, found: splice(text, found, lambda m: m["by"])
    began = time.time()
    made = df.select("text", "found", splice_of(F.col("text"), F.col("found")).alias("out")).first()
    assert time.time() - began < 15
    assert made.out == turn_by_turn(made.text, made.found)


def test_running(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(values[:n],) for n in range(len(values) + 1)], "v array<int>")
    for made in df.select("v", running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("most"), running(F.col("v"), lambda a, b: a + b).alias("sum")).collect():
        assert made["most"] == list(accumulate(made.v, max)) and made["sum"] == list(accumulate(made.v))
