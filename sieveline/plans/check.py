"""Checking files: what ``check`` prints, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decide import decide
from ..operators.scan import scan
from ..sources.rules import Rule


def check(files: DataFrame, rules: list[Rule], text_column: str = "text", quiet: bool = False) -> DataFrame:
    """``files`` with ``n_matches, blocked, matched, error, messages``.

    Needs a ``path`` column; a ``missing`` column marks files that aren't
    there. Files are the tool channel without a tool, so rules bound to a tool
    don't apply, nor do path patterns. A null text is skipped.
    """
    missing = F.col("missing") if "missing" in files.columns else F.lit(False)
    found = decide(scan(files, rules, text_column), text_column)
    n = F.coalesce(F.size("matches"), F.lit(0)).cast("bigint")
    blocked = F.col("decision") == "block"
    path = F.col("path")
    head = F.concat(path, F.lit(":"))
    lines = F.concat(F.array(head), F.transform("block_reasons", lambda r: F.concat(F.lit("  BLOCKED: "), r)))
    count = F.array() if quiet else F.array(F.concat(head, F.lit(" "), n.cast("string"), F.lit(" redaction match(es)")))
    messages = F.when(missing, F.array(F.concat(F.lit("Error: File not found: "), path))).when(blocked, lines).when(n > 0, count.cast("array<string>")).otherwise(F.array().cast("array<string>"))
    return found.select(*files.columns, n.alias("n_matches"), (blocked & ~missing).alias("blocked"), ((n > 0) & ~missing).alias("matched"), missing.alias("error"), messages.alias("messages"))


def summarize(checked: DataFrame, *by: str) -> DataFrame:
    """Whether anything was blocked, matched or missing, and the exit code, overall or by columns: 2, else 1, else 0."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    out = checked.groupBy(*by).agg(flag("blocked"), flag("matched"), flag("error"), F.count("*").alias("n_files"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"))
    return out.withColumn("exit_code", F.when(F.col("blocked"), 2).when(F.col("error"), 1).otherwise(0))
