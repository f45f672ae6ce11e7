"""Event decisions and the mapping table over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import vault
from ..plans.events import decide_events
from ..sources.rules import Rule


def decisions(events: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """``decide_events`` over a stream of JSON lines: a map without state, so no watermark is needed."""
    return decide_events(events, rules, **options)


def write_decisions(events: DataFrame, rules: list[Rule], path: str, checkpoint: str, vault_path: str | None = None, store: str = "hash", once: bool = True, **options) -> StreamingQuery:
    """Append a stream's decisions to ``path``, and its new values to the mapping table.

    Values that the table knows keep their replacements, whatever the rules
    make of them now. Each micro-batch is written under its own number, so
    that one that runs again after a failure replaces its rows; values are
    added by key, so running again adds none twice. Originals are kept as
    digests by default.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = vault.read(spark, vault_path) if vault_path else None
        cached: list[DataFrame] = []
        decided = decide_events(batch, rules, vault=known, store=store, cached=cached, **options).persist()
        decided.drop("matches").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if vault_path:
            vault.append(decided, vault_path, store=store)
        for table in (decided, *cached):
            table.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
