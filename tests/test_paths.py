import os.path
import random
import shlex

from pyspark.sql import functions as F

from sieveline.operators.paths import normalize, scan_paths, shell_paths, shell_words
from sieveline.sources.rules import Rule

HOME, PROJECT = "/home/user", "/work/project"


def hits(spark, glob, *paths):
    df = spark.createDataFrame([(list(paths),)], "paths array<string>")
    found = scan_paths(df, [Rule("r", path_pattern=glob)], "paths", project_dir=PROJECT, home=HOME).first().path_matches
    return [(m.text, m.start, m.end) for m in found]


def names(*found):
    return [(p, 0, len(p)) for p in found]


def test_globs(spark):
    assert hits(spark, "*.env", "/home/user/.env", "config.env", "/project/.env.local") == names("/home/user/.env", "config.env")
    assert hits(spark, "**/secrets/*", "/app/secrets/key.pem", "/deep/nested/secrets/token", "/app/config/key.pem") == names("/app/secrets/key.pem", "/deep/nested/secrets/token")
    assert hits(spark, ".env", ".env", f"{PROJECT}/.env", "/elsewhere/.env") == names(".env", f"{PROJECT}/.env", "/elsewhere/.env")
    assert hits(spark, "credentials.json", "/a/b/credentials.json") == names("/a/b/credentials.json")
    assert hits(spark, "~/.ssh/*", "~/.ssh/id_rsa", "/home/user/.ssh/id_rsa", "/root/.ssh/id_rsa") == names("~/.ssh/id_rsa", "/home/user/.ssh/id_rsa")
    assert hits(spark, "src/*", "src/a/b.py", "lib/src/x") == names("src/a/b.py")
    assert hits(spark, "[!a]?.txt", "bc.txt", "ab.txt", "abc.txt") == names("bc.txt")


def test_matches_go_by_path_then_rule(spark):
    df = spark.createDataFrame([(["/a", "/b"],), (None,), ([],)], "paths array<string>")
    rules = [Rule("one", path_pattern="*"), Rule("llm", path_pattern="*", target="llm"), Rule("bash", path_pattern="/b", tool="Bash")]
    rows = scan_paths(df, rules, "paths", tool=F.lit("Bash")).collect()
    assert [[(m.rule_id, m.text) for m in r.path_matches] for r in rows] == [[("one", "/a"), ("one", "/b"), ("bash", "/b")], [], []]


def test_lexical_normal_form(spark):
    paths = ["/a/./b/../c", "x/../y", "~", "~/z", "/", "/..", "../up", "/a//b/", "~x/y"]
    df = spark.createDataFrame([(n, p) for n, p in enumerate(paths)], "n int, p string").orderBy("n")
    got = [r[0] for r in df.select(normalize(F.col("p"), PROJECT, HOME)).collect()]
    expand = [HOME + p[1:] if p == "~" or p.startswith("~/") else p for p in paths]
    assert got == [os.path.normpath(os.path.join(PROJECT, p)) for p in expand]


def test_shell_paths(spark):
    cases = {
        "cat /etc/passwd": ["/etc/passwd"],
        "curl https://example.com/api HTTPS://x/y": [],
        "rm -r './a b' ~/c .hidden d/e plain": ["./a b", "~/c", ".hidden", "d/e"],
        "echo 'unclosed ~/a;/b ../c": ["~/a", "/b", "../c"],
        "": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "n int, c string").orderBy("n")
    assert [r[0] for r in df.select(shell_paths(F.col("c"))).collect()] == list(cases.values())


def test_shell_words_equal_the_standard_library(spark):
    def split(command):
        try:
            return shlex.split(command)
        except ValueError:
            return None

    r = random.Random(2)
    commands = ["".join(r.choice(["a", "/b", " ", "\t", "\n", "\r", "'", '"', "\\", "\\\\", '\\"', "é", "😀", "#", "''", '""', "\x0b", " ", "$1"]) for _ in range(r.randint(0, 14))) for _ in range(3_000)]
    commands += ["", " ", "cat 'a b' \"c\\\"d\" e\\ f", "x" * 300_000, "'" + "y " * 200_000 + "'", "a\\" * 100_000 + "b", '"' + "\\\\" * 100_000 + '"', "\\"]
    df = spark.createDataFrame(list(enumerate(commands)), "id int, command string").repartition(4)
    found = {x.id: x.words for x in df.select("id", shell_words(F.col("command")).alias("words")).collect()}
    assert found == {n: split(c) for n, c in enumerate(commands)}
    assert df.select(shell_words(F.lit(None).cast("string")).alias("w")).first().w is None


def test_shell_words_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("cat /a 'b/c'",)], "command string").select(shell_paths(F.col("command")).alias("p"))
    assert df.first().p == ["/a", "b/c"] and "Python" not in df._jdf.queryExecution().executedPlan().toString()
