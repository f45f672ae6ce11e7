"""Text files, events and mappings as DataFrames."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before the path in a file's URI.
_PLACE = re.compile("^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)")


def text_files(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``path, text`` of the files at ``path``; ``text`` is null for what isn't UTF-8. Line ends become "\\n"."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), text).alias("text"))


def _escaped(name: str) -> str:
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", name)


def requested_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``n, path, text, missing`` of exactly these paths, in any store that Spark reads.

    A relative path is one of the driver's folder. Only files of these names
    in the paths' folders are read; a folder that isn't there has none.
    """
    placed = [p if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", p) else posixpath.join(os.getcwd(), p) for p in paths]
    placed = [posixpath.join(*posixpath.split(p)) for p in placed]
    asked = spark.createDataFrame([(n, p, _PLACE.sub("", full)) for n, (p, full) in enumerate(zip(paths, placed, strict=True))], "n int, path string, place string")
    found = spark.createDataFrame([], "place string, text string")
    by_folder: dict = {}
    for folder, name in map(posixpath.split, placed):
        by_folder.setdefault(folder, []).append(name)
    for folder, names in by_folder.items():
        try:
            files = text_files(spark, _escaped(folder), "{" + ",".join(map(_escaped, names)) + "}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = found.union(files.select(F.regexp_replace("path", _PLACE.pattern, "").alias("place"), "text"))
    joined = asked.join(found.withColumn("there", F.lit(True)).dropDuplicates(["place"]), "place", "left")
    return joined.select("n", "path", "text", F.col("there").isNull().alias("missing"))


def events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``value``: one JSON event in each line of the text files at ``path``."""
    return (spark.readStream if streaming else spark.read).text(path)
