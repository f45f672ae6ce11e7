import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import chat, quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#é\x0b日", max_size=60))
def test_figures(text):
    m = quality.Measures(text)
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(text)


def test_verdicts_and_filter(spark):
    rng = random.Random(3)
    clean = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    texts = [None, "", clean, clean.upper(), "word " * 100, " ".join(w + "###" for w in clean.split()), " ".join(w + "!" for w in clean.split()), ("same line of text\n" * 5 + clean), clean + " " * 50_000, "x" * 50_000]
    df = spark.createDataFrame([(n, t, True) for n, t in enumerate(texts)] + [(2, clean, True)], "doc_id long, text string, kept boolean")
    rows = quality.measure_quality(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in rows if r.doc_id != 2] == [brute(t) for n, t in enumerate(texts) if n != 2]
    assert sorted(r.doc_id for r in rows if r.kept) == [2, 2, 7, 8]
    assert [r.base_failed for r in rows if r.doc_id in (0, 1, 3, 4)] == [True, True, False, True]
    kept = quality.filter_quality(df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 7, 8] and kept.columns == df.columns
    assert quality.filter_quality(df.limit(0)).count() == quality.measure_quality(df.limit(0)).count() == 0


def test_the_cascade_puts_cheap_strong_rules_first(spark):
    slow = quality.Rule("slow", lambda m: sum(range(300_000)) < 0)
    strong = quality.Rule("strong", lambda m: m.n_words < 5)
    df = spark.createDataFrame([("a b",)] * 20, "text string")
    assert [r.name for r in quality.cascade(df, (slow, strong))] == ["strong", "slow"]
    ran = []
    quality.rejected_by("a", (strong, quality.Rule("later", lambda m: ran.append(1))))
    assert not ran


PARTS = ["\\", "[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "a", "[", "]", "<", ">", "\n", "[ROLE]", "/", "INST", "[/TURN]", "😀"]
TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]"]), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_turns_come_back(turns):
    t = chat.Template()
    assert t.turns("".join(text for role, said in turns for text, _ in t.segments(role, said))) == turns
    for _, said in turns:
        escaped = t.escape(said)
        assert t.unescape(escaped) == said and not any(c in escaped for c in t.controls())


def test_conversations(spark):
    rows = [(1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "hi"), (2, 1, "assistant", "first"), (3, 1, None, None), (None, 1, "user", "x"), (4, 1, "user", "q"), (4, 2, "assistant", "é"), (4, 3, "user", "q"), (4, 4, "assistant", "\\"), (5, 1, "user", "tie b"), (5, 1, "user", "tie a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, valid int")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        said = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        loss = "".join(text for _, role, text in said if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, None: False, 4: True, 5: False}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_long_conversations_and_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(100).selectExpr("id % 3 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('x', 1000) text")
        assert sorted(r.n_turns for r in chat.read_back(chat.format_turns(df)).collect()) == [33, 33, 34]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("marks", [{"user": ("[a]", "]b[")}, {"user": ("<a\\>", "</a>")}, {"user": ("", "</a>")}, {"user": ("<a>", "<a>")}, {"user": ("<a>", "x<a>y")}])
def test_templates_whose_marks_run_into_one_another_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(marks=marks)


def test_the_sample_is_drawn_from_some_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_FILES", 2)
    df = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', cast(id % 90 AS int)) AS text").repartition(10)
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    sampled = quality._sampled(table, 1000, 1, "text")
    assert 40 < sampled.count() < 140
    assert quality._sampled(table, 20, 1, "text").count() < 60
    assert quality._sampled(table.selectExpr("doc_id", "text").where("doc_id > 10").groupBy("doc_id").agg(F.max("text").alias("text")), 1000, 1, "text").count() == 389
    plain = quality.measure_quality(table).where("kept").count()
    assert plain == quality.measure_quality(spark.createDataFrame(table.collect(), "doc_id long, text string")).where("kept").count()
