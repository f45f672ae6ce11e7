import pytest

from sieveline.sources import rules as R
from sieveline.sources.rules import Rule


def test_a_rule_needs_a_pattern():
    with pytest.raises(ValueError, match="must have pattern or path_pattern"):
        Rule("x", pattern="", path_pattern=None)


def test_files_keep_rules_and_leave_out_defaults(tmp_path):
    path = tmp_path / "a" / ".redaction_rules"
    rules = [Rule("b", "x", action="redact", replacement=""), Rule("a", path_pattern="*.env", target="llm")]
    R.save_rules_file(path, rules)
    assert R.load_rules_file(path) == rules
    text = path.read_text()
    assert "is_regex" not in text and "hashed" not in text and text.index("id: b") < text.index("id: a")


@pytest.mark.parametrize("text", ["", "other: 1\n", "rules: []\n"])
def test_files_without_rules(tmp_path, text):
    (tmp_path / "r").write_text(text)
    assert R.load_rules_file(tmp_path / "r") == [] == R.load_rules_file(tmp_path / "absent")


def test_explicit_null_stays_null_and_unknown_keys_go():
    assert R.parse_rule({"id": "a", "pattern": "x", "action": None, "odd": 1}).action is None
    with pytest.raises(KeyError):
        R.parse_rule({"pattern": "x"})


def test_project_rules_override_global_ones(tmp_path, spark):
    home, project = tmp_path / "home", tmp_path / "project"
    R.save_rules_file(R.rules_path(True, home=home), [Rule("shared", "g"), Rule("global", "g")])
    R.save_rules_file(R.rules_path(False, project), [Rule("project", "p"), Rule("shared", "p")])
    merged = R.load_rules(project, home)
    assert [(r.id, r.pattern) for r in merged] == [("shared", "p"), ("global", "g"), ("project", "p")]
    frames = [R.to_frame(spark, R.load_rules_file(p)) for p in (R.rules_path(True, home=home), R.rules_path(False, project))]
    assert R.from_frame(R.merge(*frames)) == merged


def test_hashed_rule_replaces_its_id_at_the_end(tmp_path):
    path = tmp_path / "r"
    R.save_rules_file(path, [Rule("s", "old"), Rule("t", "t")])
    rule = R.add_hashed_rule("secret", "s", path, description="d")
    assert [r.id for r in R.load_rules_file(path)] == ["t", "s"]
    assert rule.hashed and rule.pattern == R.hash_text("secret") and rule.hash_extractor == r"\b\w{4,}\b"


def test_all_errors_are_collected():
    errors = R.validate({"rules": [{"pattern": "[invalid"}, {"id": "a", "pattern": "x", "action": "zap", "target": "moon"}, {"id": "a"}, 7, {"id": "h", "pattern": "[", "hashed": True, "hash_extractor": "("}, {"id": "p", "path_pattern": 3}]})
    assert errors[0] == "Rule 1: missing required field 'id'"
    assert errors[1].startswith("Rule 1: invalid regex pattern: ")
    assert errors[2:4] == ["Rule 'a': invalid action 'zap' (must be: block, redact, warn)", "Rule 'a': invalid target 'moon' (must be: both, llm, tool)"]
    assert errors[4:6] == ["Rule 'a': duplicate id", "Rule 'a': must have 'pattern' or 'path_pattern'"]
    assert errors[6] == "Rule 4: must be a mapping"
    assert errors[7].startswith("Rule 'h': invalid hash_extractor regex: ")
    assert errors[8] == "Rule 'p': path_pattern must be a string"


def test_file_level_errors(tmp_path):
    for text, error in (("rules: 3\n", "Invalid format: 'rules' must be a list"), ("- 1\n", "Invalid format: expected a mapping with 'rules' key")):
        (tmp_path / "r").write_text(text)
        assert R.validate_rules_file(tmp_path / "r") == [error]
    (tmp_path / "r").write_text("rules: [")
    assert R.validate_rules_file(tmp_path / "r")[0].startswith("YAML syntax error: ")
    assert R.validate_rules_file(tmp_path / "absent") == []


def test_validation_over_a_table(spark):
    table = spark.createDataFrame([(0, "a", "x", "zap", "both"), (1, "a", None, "block", "both"), (2, None, "x", "block", "moon")], "ord int, rule_id string, pattern string, action string, target string").selectExpr("*", "cast(null as string) path_pattern")
    assert [tuple(r) for r in R.validation_errors(table).orderBy("ord", "error").collect()] == [
        (0, "Rule 'a': invalid action 'zap' (must be: block, redact, warn)"),
        (1, "Rule 'a': duplicate id"),
        (1, "Rule 'a': must have 'pattern' or 'path_pattern'"),
        (2, "Rule 3: invalid target 'moon' (must be: both, llm, tool)"),
        (2, "Rule 3: missing required field 'id'"),
    ]
