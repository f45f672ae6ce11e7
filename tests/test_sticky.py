import json

import pytest

from sieveline.operators import vault
from sieveline.plans.events import decide_events
from sieveline.sources.files import events
from sieveline.sources.rules import Rule
from sieveline.streaming.hooks import write_decisions
from sieveline.streaming.sticky import kept_replacements, write_sticky_decisions


def write(text):
    return json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Write", "tool_input": {"file_path": "a", "content": text}})


MAIL = Rule("mail", r"[a-z]+@x\.com", action="redact", replacement="email")
BLOCK = Rule("no", "SECRET", action="block")
FILES = [
    [write("to ann@x.com and bob@x.com"), write("ann@x.com"), "no json"],
    [write("bob@x.com SECRET"), write("nothing"), write("cid@x.com, ann@x.com"), write("cid@x.com")],
    [write("dan@x.com SECRET"), write("bob@x.com, eve@x.com")],
]


def rows(df):
    return sorted((r.value, r.decision, r.response_json or "", r.redacted_text or "") for r in df.collect())


@pytest.mark.parametrize("store", ["plain", "hash"])
def test_three_micro_batches_equal_one_batch(spark, tmp_path, store):
    source = tmp_path / "in"
    source.mkdir()
    for n, lines in enumerate(FILES):
        (source / f"{n}.txt").write_text("\n".join(lines) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    write_sticky_decisions(stream, [MAIL, BLOCK], str(tmp_path / "out"), str(tmp_path / "checkpoint"), store).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = decide_events(events(spark, str(source)), [MAIL, BLOCK])
    assert out.select("batch").distinct().count() == 3 and rows(out) == rows(batch)
    made = vault.values(batch).withColumn("original", vault.stored(vault.F.col("original"), store))
    kept = kept_replacements(spark, str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, made.select("rule_id", "original", "replacement").collect())) and kept.count() == 4


def test_first_replacements_hold_when_rules_change(spark, tmp_path):
    """As with the mapping table, which is read whole."""
    for n, by in enumerate(("1", "2", "3")):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.txt").write_text("\n".join(write(f"key-{k} and key-{k + 1}") for k in range(n, n + 2)) + "\n")
        rule = [Rule("r", "key-[0-9]", action="redact", replacement=by)]
        write_sticky_decisions(events(spark, str(folder), True), rule, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        write_decisions(events(spark, str(folder), True), rule, str(tmp_path / "other"), str(tmp_path / "checkpoint"), str(tmp_path / "vault")).awaitTermination()
    one, other = (spark.read.parquet(str(tmp_path / x)) for x in ("out", "other"))
    assert rows(one) == rows(other)
    assert {r.redacted_text for r in one.collect()} == {"1 and 1", "1 and 2", "2 and 3"}
    kept = kept_replacements(spark, str(tmp_path / "state"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, vault.first_values(vault.read(spark, str(tmp_path / "vault"))).collect()))


def test_a_micro_batch_reads_no_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(write("ann@x.com") + "\n")
    query = write_sticky_decisions(events(spark, str(tmp_path / "in"), True), [MAIL], str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert query.exception() is None and [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1:] == [1]
    plan = query._jsq.explainInternal(True)
    assert "TransformWithState" in plan and "parquet" not in plan.lower().split("physical plan")[-1]
