"""Decisions for tool and prompt events given as JSON lines."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decide import decide
from ..operators.paths import scan_paths, shell_paths
from ..operators.scan import no_matches, scan, search, unused
from ..operators.vault import with_known
from ..sources.rules import Rule

#: Fixed values of the event format.
PRE, POST, PROMPT = "PreToolUse", "PostToolUse", "UserPromptSubmit"
WRITERS = ("Write", "Edit", "MultiEdit")
FALLBACK_FIELDS = ("content", "output", "result", "text")
CONTINUE = '{"continue": true}'
#: ``try_parse_json`` takes a string of this many characters in its JSON at most; a variant has this many bytes at most.
PLAIN_STRING, VARIANT = 20_000_000, 1 << 27
#: ``from_json`` with what ``try_parse_json`` takes, and longer strings.
LONG_STRINGS = {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _keys(v: Column) -> Column:
    """An object's members; null if the value is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _member(v: Column, key: str) -> Column:
    """An object's member, which may be JSON's null; null if there is none."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def _has(v: Column, key: str) -> Column:
    return _member(v, key).isNotNull()


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _python_text(v: Column) -> Column:
    """A scalar as Python prints it; lists and objects as JSON."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull() | F.is_variant_null(v) | (kind == "VOID"), F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _parsed(value: str) -> Column:
    """JSON as a variant; null if it is invalid, an error if it is an object that no variant can hold."""
    n = F.octet_length(value)
    unheld = (n > VARIANT) & F.from_json(value, "map<string,string>", LONG_STRINGS).isNotNull()
    error = F.raise_error(F.concat(F.lit("An event of "), n.cast("string"), F.lit(f" bytes doesn't fit into a variant ({VARIANT} bytes)"))).cast("variant")
    return F.when(n > PLAIN_STRING, F.coalesce(F.from_json(value, "variant", LONG_STRINGS), F.when(unheld, error))).otherwise(F.try_parse_json(value))


def parse(events: DataFrame, value: str = "value") -> DataFrame:
    """``events`` with ``event`` (null for invalid JSON), ``event_name, tool_name, tool_input, tool_response, prompt``."""
    e = F.col("event")
    return events.withColumn("event", _parsed(value)).withColumns(
        {
            "event_name": F.coalesce(_text(e, "$.hook_event_name"), F.lit("")),
            "tool_name": F.coalesce(_text(e, "$.tool_name"), F.lit("")),
            "tool_input": F.try_variant_get(e, "$.tool_input", "variant"),
            "tool_response": F.try_variant_get(e, "$.tool_response", "variant"),
            "prompt": _text(e, "$.prompt"),
        }
    )


def input_content(tool: Column, v: Column) -> Column:
    """What is scanned of a tool's input; an empty text is empty, not null."""
    content = _text(v, "$.content")
    written = F.coalesce(_truthy(content), _text(v, "$.new_string"), content)
    return F.when(tool.isin(*WRITERS), written).when(tool == "Bash", _text(v, "$.command")).when(tool == "Read", _text(v, "$.file_path"))


def input_paths(tool: Column, v: Column) -> Column:
    """The paths that a tool's input names."""
    path = _truthy(_text(v, "$.file_path"))
    command = F.when(tool == "Bash", F.coalesce(_text(v, "$.command"), F.lit("")))
    none = F.array().cast("array<string>")
    return F.when(tool.isin("Read", *WRITERS), F.when(path.isNotNull(), F.array(path)).otherwise(none)).when(tool == "Bash", shell_paths(command)).otherwise(none)


def output_content(tool: Column, v: Column) -> Column:
    """What is scanned of a tool's output."""
    first = F.coalesce(_truthy(_text(v, "$.content")), _text(v, "$.output"))
    streams = F.array_compact(F.array(*(_truthy(_text(v, f"$.{k}")) for k in ("stdout", "stderr", "output"))))
    items = F.array_join(F.transform(F.try_variant_get(v, "$.matches", "array<variant>"), _python_text), "\n")
    listed = F.when(_has(v, "matches"), items).otherwise(_text(v, "$.output"))
    other = F.lit(None).cast("string")
    for key in reversed(FALLBACK_FIELDS):
        other = F.when(_has(v, key), _python_text(_member(v, key))).otherwise(other)
    of_object = F.when(tool.isin("Read", "WebFetch"), first).when(tool == "Bash", F.when(F.size(streams) > 0, F.array_join(streams, "\n"))).when(tool.isin("Grep", "Glob"), listed).otherwise(other)
    plain = F.when(F.schema_of_variant(v).isin("VOID"), None).otherwise(_python_text(v))
    falsy = plain.isin("", "False", "0", "[]", "None")
    return F.when(_is_object(v), of_object).when(v.isNotNull() & ~falsy, plain)


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(*members: tuple[str, Column | str]) -> Column:
    parts = []
    for n, (key, value) in enumerate(members):
        parts += [F.lit(f'{", " * bool(n)}"{key}": '), F.lit(value) if isinstance(value, str) else value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _updated_input(v: Column, tool: Column, redacted: Column) -> Column:
    """A tool's input with the redacted text in place of what was scanned; reads have no such place."""
    members = _keys(v)
    key = F.when(tool.isin(*WRITERS), F.when(_has(v, "content"), "content").when(_has(v, "new_string"), "new_string")).when(tool == "Bash", "command")
    written = lambda e: F.when(e["key"] == key, _quoted(redacted)).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null")))
    entries = F.transform(F.map_entries(members), lambda e: F.concat(_quoted(e["key"]), F.lit(": "), written(e)))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def _content_rules(rules: list[Rule]) -> list[Rule]:
    return [rule for rule in rules if rule.pattern]


def search_events(df: DataFrame, rules: list[Rule], text_column: str = "text", out: str = "searched") -> DataFrame:
    """``df`` with a column ``out`` for :func:`decide_events`: the matches in a text that several events made of a row will hold."""
    return search(df, _content_rules(rules), text_column, out)


def _scans(df: DataFrame, rules: list[Rule], project_dir: str | None, home: str | None, searched: str | None) -> DataFrame:
    """``matches``: for events before a tool's use path rules, content rules, then rules of both kinds; else content alone."""
    event, tool = F.col("event_name"), F.col("tool_name")
    pre = event == PRE
    content = _content_rules(rules)
    path_only = [rule for rule in rules if rule.path_pattern and not rule.pattern]
    both = [rule for rule in rules if rule.path_pattern and rule.pattern]
    channel = F.when(event == PROMPT, "llm").otherwise("tool")
    tool = F.when(event != PROMPT, tool)
    df = scan_paths(df, path_only, "paths", "tool", tool, "__paths", project_dir, home)
    df = scan_paths(df, both, "paths", "tool", tool, "__both", project_dir, home)
    df = df.withColumn("__hit", F.transform("__both", lambda m: m["rule_id"]))
    # a rule of both kinds counts before a tool's use only where its path was hit
    df = scan(df, content, "content", channel, tool, "__content", {n: ~pre | F.array_contains("__hit", rule.id) for n, rule in enumerate(content) if rule.path_pattern}, searched)
    combined = [rule.id for rule in both]
    is_both = lambda m: m["rule_id"].isin(*combined) if combined else F.lit(False)
    ordered = F.when(pre, F.concat("__paths", F.filter("__content", lambda m: ~is_both(m)), F.filter("__content", is_both))).otherwise(F.col("__content"))
    return df.withColumn("matches", F.coalesce(ordered, no_matches())).drop("__paths", "__both", "__hit", "__content")


def decide_events(events: DataFrame, rules: list[Rule], value: str = "value", project_dir: str | None = None, home: str | None = None, vault: DataFrame | None = None, store: str = "plain", cached: list | None = None, searched: str | None = None) -> DataFrame:
    """``events`` with ``event_name, tool_name, content, decision, exit_code, response_json, stderr_lines`` and the reasons.

    ``decision`` is block, redact, warn, allow or invalid (no JSON; exit code
    1). Only what a tool is about to do can be rewritten; prompts and outputs
    that would need it get a line on stderr. No shuffle: the same plan runs
    over a stream. With a ``vault`` (of a batch's events; ``store`` says how it
    keeps originals) values that it knows keep the replacements it has; tables
    that are cached for it are added to ``cached``. ``searched`` names a column of
    :func:`search_events`: events whose content, as read from their JSON, is
    the text searched there aren't searched again.
    """
    project_dir, home = project_dir or str(Path.cwd()), home or str(Path.home())
    kept = events.columns
    df = parse(events, value)
    event, tool = F.col("event_name"), F.col("tool_name")
    content = F.when(event == PRE, input_content(tool, F.col("tool_input"))).when(event == POST, output_content(tool, F.col("tool_response"))).when(event == PROMPT, F.col("prompt"))
    paths = F.when(event == PRE, input_paths(tool, F.col("tool_input")))
    df = df.withColumn("content", _truthy(content)).withColumn("paths", paths)
    # the event itself holds its text once more, so it isn't carried through the scans
    no_json = unused(df, "no_json")
    df = df.withColumn(no_json, F.col("event").isNull())
    df, known = _scans(df, rules, project_dir, home, searched), None
    if vault is not None:
        known = unused(df, "known")
        df = with_known(df, vault, store=store, out=known, cached=cached)
    df = decide(df, "content", known=known)
    blocks, joined = F.col("block_reasons"), F.array_join("block_reasons", "; ")
    changed = (event == PRE) & F.col("content").isNotNull() & (F.coalesce("redacted_text", F.lit("")) != "") & (F.col("redacted_text") != F.col("content"))
    said = F.when(event == POST, "Tool output blocked: ").when(event == PROMPT, "Prompt blocked: ").otherwise("Blocked: ")
    deny = _object(
        ("hookSpecificOutput", _object(("hookEventName", f'"{PRE}"'), ("permissionDecision", '"deny"'), ("permissionDecisionReason", _quoted(joined)))),
        ("continue", "false"),
        ("stopReason", _quoted(F.concat(F.lit("Blocked by redaction rules: "), joined))),
    )
    block = _object(("decision", '"block"'), ("reason", _quoted(F.concat(said, joined))), ("hookSpecificOutput", _object(("hookEventName", _quoted(event)))))
    rewrite = _object(
        ("hookSpecificOutput", _object(("hookEventName", f'"{PRE}"'), ("permissionDecision", '"allow"'), ("permissionDecisionReason", '"Content redacted"'), ("updatedInput", _updated_input(F.col("tool_input"), tool, F.col("redacted_text"))))),
        ("continue", "true"),
        ("systemMessage", '"Content was redacted before execution"'),
    )
    invalid, blocked = F.col(no_json), F.size(blocks) > 0
    known = event.isin(PRE, POST, PROMPT)
    response = F.when(invalid, F.lit(None).cast("string")).when(blocked, F.when(event == PRE, deny).otherwise(block)).when(changed, rewrite).otherwise(F.lit(CONTINUE))
    warned = F.transform("warn_reasons", lambda r: F.concat(F.lit("Warning: "), r))
    cannot = F.when(event == POST, "] cannot modify tool output").otherwise("] cannot modify prompts")
    last = F.when(blocked, F.array(F.concat(said, joined))).when((event != PRE) & (F.col("redact_ids") != ""), F.array(F.concat(F.lit("Warning: redact rules ["), F.col("redact_ids"), cannot)))
    stderr = F.when(invalid, F.array(F.lit("Invalid JSON input"))).otherwise(F.concat(warned, F.coalesce(last, F.array().cast("array<string>"))))
    verdict = F.when(invalid, "invalid").when(~known, "allow").otherwise(F.col("decision"))
    return df.select(
        *kept,
        "event_name",
        "tool_name",
        "content",
        verdict.alias("decision"),
        F.when(invalid, 1).when(blocked, 2).otherwise(0).alias("exit_code"),
        response.alias("response_json"),
        stderr.alias("stderr_lines"),
        "block_reasons",
        "warn_reasons",
        "redacted_text",
        "matches",
    )
