"""Paths: what a shell command names, lexical normal forms, globs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect
from ..functions.spans import let
from ..sources.rules import Rule
from .scan import NONE, applies, as_match, no_matches

#: Fixed patterns: what looks like a path, what is a URL, and paths in a command that can't be split.
PATH_START, URL = r"^[~/.]", r"(?i)^https?://"
FALLBACK = r"(?:^|[\s;|&])([~/][^\s;|&]+|\.\.?/[^\s;|&]+)"


#: What a shell word is made of: plain characters, an escaped one, a text in single or in double quotes. Possessive, so that Java goes through it without recursion.
_PART = r"""[^ \t\r\n'"\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+\""""
_WORD, _WELL_FORMED = f"(?s)(?:{_PART})++", rf"(?s)\A(?:[ \t\r\n]++|{_PART})*+\z"


def shell_words(command: Column) -> Column:
    """A command's words by the shell's quoting rules; null for an open quote or a last backslash."""

    def plain(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        quoted = F.regexp_replace(inner, r"""\\(["\\])""", "$1")
        return F.when(part.startswith("'"), inner).when(part.startswith('"'), quoted).when(part.startswith("\\"), F.substring(part, 2, 1)).otherwise(part)

    word = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"(?s){_PART}"), F.lit(0)), plain), "")
    return F.when(command.rlike(_WELL_FORMED), F.transform(F.regexp_extract_all(command, F.lit(_WORD), F.lit(0)), word))


def shell_paths(command: Column) -> Column:
    """The paths that a shell command names, in order: no URLs; with a "/" anywhere or a path's start."""
    java = dialect.to_java(FALLBACK) or FALLBACK
    loose = F.regexp_extract_all(command, F.lit(java), F.lit(1))
    named = F.filter(shell_words(command), lambda t: ~t.rlike(URL) & (t.rlike(PATH_START) | t.contains("/")))
    return F.coalesce(named, loose)


def _fold(path: Column) -> Column:
    """An absolute path without empty, "." and ".." parts."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def normalize(path: Column, project_dir: str, home: str) -> Column:
    """``~`` expanded, relative paths put into the project, dots folded.

    Lexical only: links can't be followed on a cluster.
    """
    full = F.when(path.rlike(r"^~(?=/|\z)"), F.concat(F.lit(home), F.substring(path, F.lit(2), F.length(path)))).otherwise(path)
    return _fold(F.when(full.startswith("/"), full).otherwise(F.concat(F.lit(project_dir.rstrip("/") + "/"), full)))


def path_matches(glob: str, path: Column, project_dir: str, home: str) -> Column:
    """Whether a glob fits a normalized path as a whole, or relative to the project, or its last part."""
    if glob.startswith("~/"):
        glob = home + glob[1:]
    pattern = dialect.glob_to_java(glob)
    inside = project_dir.rstrip("/") + "/"
    relative = F.when(path.startswith(inside), F.substring(path, F.lit(len(inside) + 1), F.length(path))).when(path == F.lit(inside[:-1] or "/"), F.lit("."))
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike(pattern) | F.coalesce(relative.rlike(pattern), F.lit(False)) | name.rlike(pattern)


def scan_paths(df: DataFrame, rules: list[Rule], paths_column: str, channel: Column | str = "tool", tool: Column | None = None, out: str = "path_matches", project_dir: str | None = None, home: str | None = None) -> DataFrame:
    """``df`` with an array of the matches of path rules: by path, then by rule.

    A match spans the path as it was given. ``paths_column`` is an array of
    strings; a null array has no matches.
    """
    project_dir, home = project_dir or str(Path.cwd()), home or str(Path.home())
    usable = [(n, rule, test) for n, rule in enumerate(rules) if rule.path_pattern and (test := applies(rule, channel, tool)) is not False]

    def of_path(path: Column) -> Column:
        def tested(normal: Column) -> Column:
            each = []
            for n, rule, test in usable:
                fits = path_matches(rule.path_pattern, normal, project_dir, home)
                each.append(F.when(fits if test is True else fits & test, as_match(rule, n, F.lit(0), F.length(path), path)))
            return F.array_compact(F.array(*each))

        return let(normalize(path, project_dir, home), tested)

    found = F.flatten(F.transform(F.col(paths_column), of_path)).cast(NONE) if usable else no_matches()
    return df.withColumn(out, F.coalesce(found, no_matches()))
