import json
import os

from pyspark.sql import functions as F

from sieveline.plans.events import decide_events
from sieveline.sources.rules import Rule
from sieveline.streaming.timely import decisions, late_events, repeated_events, write_timely_decisions

RULES = [Rule("mail", r"[a-z]+@x\.com", action="redact", replacement="email"), Rule("no", "SECRET")]


def event(id_, minute, text, time=True):
    value = json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Write", "tool_input": {"file_path": "a", "content": text}})
    return {"event_id": id_, "time": f"2024-01-01T10:{minute:02d}:00Z" if time else None, "value": value}


BATCHES = [
    [event("a", 0, "ann@x.com"), event("b", 1, "SECRET"), event("a", 0, "ann@x.com"), event(None, 2, "plain"), event("n", 0, "no time", time=False)],
    [event("b", 1, "SECRET"), event("c", 30, "bob@x.com"), event(None, 2, "plain"), event("d", 25, "x")],
    [event("c", 30, "bob@x.com"), event("e", 40, "y"), event("a", 0, "ann@x.com"), event("f", 29, "in time")],
    [event("late", 5, "ann@x.com"), event("late", 5, "ann@x.com"), event("a", 0, "ann@x.com")],
    [event("later", 6, "z")],
]
SCHEMA = "event_id string, time timestamp, value string"


def stream(spark, folder):
    for n, rows in enumerate(BATCHES):
        file = folder / f"{n}.json"
        file.write_text("\n".join(map(json.dumps, rows)) + "\n")
        os.utime(file, (n + 1, n + 1))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_and_repeated_events(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    events = stream(spark, folder)
    write_timely_decisions(events, RULES, out, str(tmp_path / "checkpoint")).awaitTermination()
    made = decisions(spark, out)
    got = {x.event_id: (x.decision, x.value) for x in made.collect()}
    assert made.count() == len(got) == 7 and {"a", "b", "c", "d", "e", "f"} < set(got)
    # The same events once each, as a batch decides them.
    whole = spark.read.schema(SCHEMA).json(str(folder)).dropDuplicates(["value", "event_id"]).where("time is not null and coalesce(event_id, '') not in ('late', 'later')")
    expected = decide_events(whole.select("value"), RULES).select("value", "decision")
    assert sorted((v, d) for d, v in got.values()) == sorted(map(tuple, expected.collect()))
    assert sorted(x.event_id for x in late_events(spark, out).collect()) == ["late", "late", "later", "n"]
    again = [x.event_id for x in repeated_events(spark, out).collect()]
    assert sorted(i for i in again if not i.startswith("sha256:")) == ["a", "a", "b", "c"] and len(again) == 5


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, rows in enumerate(BATCHES):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
        events = spark.readStream.schema(SCHEMA).json(str(folder))
        write_timely_decisions(events, RULES, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(x.event_id for x in late_events(spark, out).collect()) == ["late", "late", "later", "n"]
    assert decisions(spark, out).count() == 7 and decisions(spark, out).select(F.countDistinct("event_id")).first()[0] == 7
