"""The rule catalog: rules, their files, merging, validation.

A catalog is small and lives on the driver as a list of ``Rule``; ``to_frame``
gives it as a table, and merging and validation are also offered over tables,
for catalogs that are kept in one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the catalog's format.
ACTIONS = ("block", "redact", "warn")
TARGETS = ("both", "llm", "tool")
EXTRACTOR = r"\b\w{4,}\b"
#: Places of a catalog in a table that are numbered together.
STRETCH = 4096
RULES_FILE = ".redaction_rules"
GLOBAL_DIR = ".sieveline"


@dataclass(frozen=True)
class Rule:
    """One rule. ``pattern`` is a regex, a literal or a digest; ``path_pattern`` a glob."""

    id: str
    pattern: str | None = None
    path_pattern: str | None = None
    is_regex: bool = True
    hashed: bool = False
    hash_extractor: str | None = None
    action: str = "block"
    replacement: str | None = None
    target: str = "both"
    tool: str | None = None
    description: str = ""

    def __post_init__(self):
        if not (self.pattern or self.path_pattern):
            raise ValueError(f"Rule '{self.id}': must have pattern or path_pattern")

    @property
    def reason(self) -> str:
        return f"[{self.id}] {self.description or 'Pattern matched'}"


SCHEMA = "ord int, rule_id string, pattern string, path_pattern string, is_regex boolean, hashed boolean, hash_extractor string, action string, replacement string, target string, tool string, description string"


def to_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(n, *asdict(rule).values()) for n, rule in enumerate(rules)], SCHEMA)


def from_frame(rules: DataFrame) -> list[Rule]:
    """The catalog in a table; a catalog is small by nature."""
    names = ["rule_id", *(f.name for f in fields(Rule)[1:])]
    return [Rule(*row) for row in rules.orderBy("ord").select(*names).collect()]


def parse_rule(entry: dict) -> Rule:
    """A rule from a file's mapping: unknown keys are dropped, absent ones take their defaults, a null stays null."""
    if "id" not in entry:
        raise KeyError("id")
    return Rule(**{f.name: entry[f.name] for f in fields(Rule) if f.name in entry})


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("rule files need PyYAML") from error
    return yaml


def load_rules_file(path) -> list[Rule]:
    """The rules of a YAML file; none if it is absent, empty or has no list of rules."""
    path = Path(path)
    data = _yaml().safe_load(path.read_text()) if path.exists() else None
    return [parse_rule(entry) for entry in data["rules"]] if data and "rules" in data else []


def save_rules_file(path, rules: list[Rule]) -> None:
    """Write the rules in order; values that equal their default are left out."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    entries = [{f.name: value for f in fields(Rule) if (value := getattr(rule, f.name)) is not None and (value != f.default or f.name == "id")} for rule in rules]
    path.write_text(_yaml().dump({"rules": entries}, default_flow_style=False, sort_keys=False))


def rules_path(global_: bool = False, project_dir=None, home=None) -> Path:
    """Where a project's rules or the global ones are kept."""
    return (Path(home or Path.home()) / GLOBAL_DIR if global_ else Path(project_dir or Path.cwd())) / RULES_FILE


def load_rules(project_dir=None, home=None) -> list[Rule]:
    """Global and project rules; of rules with one id the last counts, at the place of the first."""
    found = [*load_rules_file(rules_path(True, home=home)), *load_rules_file(rules_path(False, project_dir))]
    return list({rule.id: rule for rule in found}.values())


def merge(*scopes: DataFrame) -> DataFrame:
    """``load_rules`` over tables: later scopes override earlier ones by ``rule_id``, places are kept."""
    body = [c.split()[0] for c in SCHEMA.split(", ")][2:]
    united = None
    for scope, rules in enumerate(scopes):
        placed = rules.withColumn("at", F.struct(F.lit(scope).alias("scope"), F.col("ord").alias("pos")))
        united = placed if united is None else united.unionByName(placed)
    merged = united.groupBy("rule_id").agg(F.max_by(F.struct(*body), "at").alias("body"), F.min("at").alias("first"))
    # places are numbered within stretches, and only the stretches' sizes are added up in one task
    stretch = F.struct("first.scope", F.floor(F.col("first.pos") / STRETCH).alias("n"))
    merged = merged.withColumn("stretch", stretch)
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("stretch").count().select("stretch", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("stretch").orderBy("first"))
    return merged.withColumn("within", within).join(starts, "stretch").select((F.col("start") + F.col("within") - 1).cast("int").alias("ord"), "rule_id", "body.*")


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hashed_rule(secret: str, rule_id: str, description: str = "", hash_extractor: str = EXTRACTOR, action: str = "block", target: str = "both") -> Rule:
    """A rule that knows a secret by its digest only."""
    return Rule(rule_id, hash_text(secret), hashed=True, hash_extractor=hash_extractor, action=action, target=target, description=description)


def add_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """``rules`` with ``rule`` at the end, in place of any of its id."""
    return [*(r for r in rules if r.id != rule.id), rule]


def add_hashed_rule(secret: str, rule_id: str, path=None, **options) -> Rule:
    """Add a hashed rule to a file."""
    path = path or rules_path()
    rule = hashed_rule(secret, rule_id, **options)
    save_rules_file(path, add_rule(load_rules_file(path), rule))
    return rule


def hashed(rules: DataFrame) -> DataFrame:
    """The rules that know a secret by its digest, with all their columns."""
    return rules.where(F.coalesce("hashed", F.lit(False)))


def _regex_error(pattern) -> str | None:
    try:
        re.compile(pattern)
    except re.error as error:
        return str(error)
    return None


@F.pandas_udf(T.StringType())
def _regex_errors(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else _regex_error(p))


def validate(data) -> list[str]:
    """All errors of a file's content; keys count where they are present, whatever their value."""
    if data is None:
        return []
    if not isinstance(data, dict):
        return ["Invalid format: expected a mapping with 'rules' key"]
    entries = data.get("rules", [])
    if not isinstance(entries, list):
        return ["Invalid format: 'rules' must be a list"]
    errors, seen = [], set()
    for n, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            errors.append(f"Rule {n}: must be a mapping")
            continue
        name = f"Rule '{entry['id']}'" if "id" in entry else f"Rule {n}"
        checks = (
            ("id" not in entry, "missing required field 'id'"),
            ("id" in entry and entry["id"] in seen, "duplicate id"),
            (not entry.keys() & {"pattern", "path_pattern"}, "must have 'pattern' or 'path_pattern'"),
            ("pattern" in entry and entry.get("is_regex", True) and not entry.get("hashed", False) and _regex_error(entry["pattern"]), "invalid regex pattern: {}"),
            ("path_pattern" in entry and not isinstance(entry["path_pattern"], str), "path_pattern must be a string"),
            ("hash_extractor" in entry and _regex_error(entry["hash_extractor"]), "invalid hash_extractor regex: {}"),
            ("action" in entry and entry["action"] not in ACTIONS, f"invalid action '{entry.get('action')}' (must be: {', '.join(sorted(ACTIONS))})"),
            ("target" in entry and entry["target"] not in TARGETS, f"invalid target '{entry.get('target')}' (must be: {', '.join(sorted(TARGETS))})"),
        )
        errors += [f"{name}: {message.replace('{}', str(found))}" for found, message in checks if found]
        if "id" in entry:
            seen.add(entry["id"])
    return errors


def validate_rules_file(path) -> list[str]:
    path = Path(path)
    if not path.exists():
        return []
    yaml = _yaml()
    try:
        data = yaml.safe_load(path.read_text())
    except yaml.YAMLError as error:
        return [f"YAML syntax error: {error}"]
    return validate(data)


def validation_errors(rules: DataFrame) -> DataFrame:
    """``ord, error`` for rules kept in a table; a null, or a column that isn't there, stands for an absent key."""
    default = lambda name, value: F.coalesce(name, F.lit(value)) if name in rules.columns else F.lit(value)
    plain = default("is_regex", True) & ~default("hashed", False)
    broken = _regex_errors(F.when(plain, F.col("pattern")))
    extractor = _regex_errors(F.col("hash_extractor")) if "hash_extractor" in rules.columns else F.lit(None).cast("string")
    name = F.coalesce(F.concat(F.lit("Rule '"), "rule_id", F.lit("'")), F.concat(F.lit("Rule "), (F.col("ord") + 1).cast("string")))
    again = F.row_number().over(Window.partitionBy("rule_id").orderBy("ord")) > 1
    quoted = lambda what, column, valid: F.concat(F.lit(f"invalid {what} '"), column, F.lit(f"' (must be: {', '.join(sorted(valid))})"))
    checks = F.array(
        F.when(F.col("rule_id").isNull(), "missing required field 'id'"),
        F.when(F.col("rule_id").isNotNull() & again, "duplicate id"),
        F.when(F.col("pattern").isNull() & F.col("path_pattern").isNull(), "must have 'pattern' or 'path_pattern'"),
        F.concat(F.lit("invalid regex pattern: "), broken),
        F.concat(F.lit("invalid hash_extractor regex: "), extractor),
        F.when(~F.col("action").isin(*ACTIONS), quoted("action", F.col("action"), ACTIONS)),
        F.when(~F.col("target").isin(*TARGETS), quoted("target", F.col("target"), TARGETS)),
    )
    found = rules.select("ord", name.alias("name"), F.array_compact(checks).alias("errors"))
    return found.select("ord", "name", F.explode("errors").alias("error")).select("ord", F.concat_ws(": ", "name", "error").alias("error"))
