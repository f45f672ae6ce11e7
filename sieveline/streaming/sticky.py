"""Replacements that hold over a stream, kept as keyed state.

Each rule and value is a key whose state is the replacement that it was given
first. A micro-batch touches the keys of its own values alone, so its cost
doesn't grow with what was ever seen, as reading a mapping table would. The
state is versioned with the stream's checkpoint: a micro-batch that runs again
after a failure finds what it found before.
"""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import vault
from ..operators.decide import replacement_of
from ..plans.events import decide_events
from ..sources.rules import Rule

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VARIABLE = "kept"


class FirstReplacement(StatefulProcessor):
    """The replacement that a key was given first; of several in one micro-batch the least."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState(_VARIABLE, "replacement string")

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        if not self.kept.exists():
            self.kept.update((min(part["replacement"].min() for part in parts),))
        one = parts[0].head(1).copy()
        one["replacement"] = self.kept.get()[0]
        yield one

    def close(self) -> None:
        pass


def _distinct_rows(batches):
    """Equal rows of a batch once: a value that many events hold doesn't meet in one task as often."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(batch.schema.names[:2]).aggregate([("replacement", "min")])
        yield from table.rename_columns(batch.schema.names).cast(batch.schema).to_batches()


def first_replacements(decided: DataFrame, store: str = "hash") -> DataFrame:
    """``rule_id, original, replacement``: for each value of a stream's redacting matches what it is given, first writer first.

    ``original`` is as ``store`` keeps it. Values of blocked rows don't count.
    """
    free = decided.where(~F.exists("matches", lambda m: F.coalesce(m["action"] == "block", F.lit(False))))
    found = free.select(F.explode("matches").alias("m")).where(~F.coalesce(F.col("m.action").isin("block", "warn"), F.lit(False)))
    values = found.select(F.col("m.rule_id").alias("rule_id"), vault.stored(F.col("m.text"), store).alias("original"), replacement_of(F.col("m")).alias("replacement"))
    return values.mapInArrow(_distinct_rows, vault.SCHEMA).groupBy("rule_id", "original").transformWithStateInPandas(FirstReplacement(), vault.SCHEMA, "Append", "None")


@contextmanager
def _keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def write_sticky_decisions(events: DataFrame, rules: list[Rule], path: str, checkpoint: str, store: str = "hash", once: bool = True, **options) -> StreamingQuery:
    """Append a stream's decisions to ``path``; values keep the replacements that this stream gave them first.

    What ``hooks.write_decisions`` does with a mapping table, with keyed state
    instead: events go by as they are, their values alone go through the state,
    and the micro-batch joins the two. Each micro-batch is written under its
    own number, so one that runs again replaces its rows. Null and invalid
    events are decided like in a batch and have no values. ``checkpoint`` has
    to be a folder that all executors share. The number of the session's
    shuffle partitions is fixed with the first run.
    """
    spark = events.sparkSession
    nothing = F.lit(None).cast("string")
    values = first_replacements(decide_events(events, rules, **options), store).withColumns({"value": nothing, "event": F.lit(False)})
    plain = events.select("value", nothing.alias("rule_id"), nothing.alias("original"), nothing.alias("replacement"), F.lit(True).alias("event"))

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        known = held.where("not event").select("rule_id", "original", "replacement")
        cached = [held]
        decided = decide_events(held.where("event").select("value"), rules, vault=known, store=store, cached=cached, **options)
        decided.drop("matches").write.mode("overwrite").parquet(f"{path}/batch={number}")
        for table in cached:
            table.unpersist()

    with _keyed_state(spark):
        writer = plain.unionByName(values).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def kept_replacements(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stream as a mapping table, ``rule_id, original, replacement``, read as a batch."""
    state = spark.read.format("statestore").option("stateVarName", _VARIABLE).load(checkpoint)
    return state.select("key.rule_id", "key.original", "value.replacement")
