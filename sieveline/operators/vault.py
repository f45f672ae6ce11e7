"""The mapping table: which replacement a value was given first.

``(rule_id, original, replacement)``, one row for each of the first two. New
values are added, known ones keep what they have.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pseudonyms import digest
from .decide import replacement_of
from .scan import once, unused

SCHEMA = "rule_id string, original string, replacement string"
STORES = ("plain", "hash")
#: Maps of kept replacements up to which a join sends them to all executors.
BROADCAST_MAPS = 50_000


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def values(df: DataFrame, matches: str = "matches") -> DataFrame:
    """The distinct values of redacting matches in rows that aren't blocked, and what their rules make of them."""
    free = df.where(~F.exists(F.col(matches), lambda m: F.coalesce(m["action"] == "block", F.lit(False))))
    found = free.select(F.explode(matches).alias("m")).where(~F.coalesce(F.col("m.action").isin("block", "warn"), F.lit(False)))
    made = found.select(F.col("m.rule_id").alias("rule_id"), F.col("m.text").alias("original"), replacement_of(F.col("m")).alias("replacement"))
    return made.groupBy("rule_id", "original").agg(F.min("replacement").alias("replacement"))


def stored(original: Column, store: str) -> Column:
    """How a value stands in a vault: itself, or with ``store="hash"`` its digest."""
    if store not in STORES:
        raise ValueError(f"store must be one of {STORES}")
    return digest(original) if store == "hash" else original


def first_values(vault: DataFrame) -> DataFrame:
    """``vault`` with one row for each ``(rule_id, original)``, whatever two writers may have made of it."""
    return vault.groupBy("rule_id", "original").agg(F.min("replacement").alias("replacement"))


def new_values(df: DataFrame, vault: DataFrame, matches: str = "matches", store: str = "plain") -> DataFrame:
    """Rows to append to the vault after ``df``."""
    return values(df, matches).withColumn("original", stored(F.col("original"), store)).join(vault, ["rule_id", "original"], "left_anti")


def resolve(df: DataFrame, vault: DataFrame, matches: str = "matches", store: str = "plain") -> DataFrame:
    """The values that ``df`` uses with their replacements, kept and new; ``original`` is plain whatever the vault stores."""
    kept = first_values(vault).select("rule_id", F.col("original").alias("stored"), F.col("replacement").alias("kept"))
    found = values(df, matches).withColumn("stored", stored(F.col("original"), store))
    return found.join(kept, ["rule_id", "stored"], "left").select("rule_id", "original", F.coalesce("kept", "replacement").alias("replacement"))


def with_known(df: DataFrame, vault: DataFrame, matches: str = "matches", store: str = "plain", out: str = "known", cached: list | None = None) -> DataFrame:
    """``df`` with the map that ``decide`` takes, from "rule id, newline, value" to kept replacements; null where a row has none.

    Rows with redacting matches are told apart by their values alone, so
    ``df`` needs no key, and rows with the same values share a map. Up to
    ``BROADCAST_MAPS`` maps are sent to all executors and no text is shuffled;
    with more, rows without values are spread by a salt. The table of maps is
    cached; it is added to the list ``cached``, for the caller to release.
    """
    redacting = F.filter(matches, lambda m: ~F.coalesce(m["action"].isin("block", "warn"), F.lit(False)))
    pairs = F.array_sort(F.array_distinct(F.transform(redacting, lambda m: F.struct(m["rule_id"].alias("rule_id"), m["text"].alias("original")))))
    key, salt = unused(df, "values"), unused(df, "salt")
    keyed = once(df, key, pairs)
    used = keyed.where(F.size(key) > 0).select(key).distinct().select(key, F.explode(key).alias("v"))
    used = used.select(key, "v.rule_id", "v.original", stored(F.col("v.original"), store).alias("stored"))
    found = used.join(first_values(vault).withColumnRenamed("original", "stored"), ["rule_id", "stored"])
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\n", "rule_id", "original"), "replacement"))).alias(out)).persist()
    if cached is not None:
        cached.append(maps)
    if maps.limit(BROADCAST_MAPS + 1).count() <= BROADCAST_MAPS:
        return keyed.join(F.broadcast(maps), key, "left").drop(key)
    spread = F.when(F.size(key) > 0, F.lit(0)).otherwise(F.floor(F.rand() * 4096).cast("int"))
    return keyed.withColumn(salt, spread).join(maps.withColumn(salt, F.lit(0)), [key, salt], "left").drop(key, salt)


def append(df: DataFrame, path: str, matches: str = "matches", store: str = "plain") -> None:
    """Add the new values of ``df`` to the Parquet table at ``path``.

    ``store="hash"`` keeps the digest of an original in place of the original.
    Two writers at once may add a value twice; readers then all take the same
    one of the two (``first_values``).
    """
    vault = read(df.sparkSession, path)
    new_values(df, vault, matches, store).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The vault at ``path``; empty if nothing has been written there."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return empty(spark)


def vault_path(base: str, project: str | None = None) -> str:
    """Where the mapping table of a project, or the global one, is kept under ``base``."""
    return f"{base.rstrip('/')}/{project or 'global'}"


def export_json(vault: DataFrame) -> DataFrame:
    """``json``: a line for each value, ``{"mappings": {rule id: {original: replacement}}}``; ``write.text`` makes files of it.

    Lines are made where the rows are, so a vault of any size can be handed
    out; ``import_json`` takes such lines, or whole mappings in one.
    """
    one = F.create_map("rule_id", F.create_map("original", "replacement"))
    return first_values(vault).select(F.to_json(F.struct(one.alias("mappings"))).alias("json"))


def import_json(files: DataFrame) -> DataFrame:
    """The rows of exported texts in column ``json``; a malformed text has none."""
    parsed = files.select(F.from_json("json", "mappings map<string, map<string, string>>").alias("p"))
    return parsed.select(F.explode("p.mappings").alias("rule_id", "values")).select("rule_id", F.explode("values").alias("original", "replacement"))
