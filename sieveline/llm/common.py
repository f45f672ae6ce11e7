"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees, in the folder that the session names in ``spark.checkpoint.dir``.

    The folder of a session that names none would be seen by one machine
    alone, so that is an error. Spark doesn't clear the folder; whoever sets
    it decides how long cuts are kept.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages read committed files, so a lost executor
    never makes them see a second, different computation of the same rows.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def broadcast_if_small(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small; a larger table goes through a shuffled join.

    ``limit`` bounds the rows, or the sum of ``weight`` where rows differ in
    size: it should count a row's values of about eight bytes.
    """
    if weight is None:
        size = df.limit(limit + 1).count()
    else:
        size = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
