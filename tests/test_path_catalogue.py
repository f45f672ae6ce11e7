import fnmatch
import random
import time

from pyspark.sql import functions as F

from sieveline.operators.path_catalogue import Globs, scan_path_catalogue
from sieveline.operators.paths import scan_paths
from sieveline.sources.rules import Rule

PLACE = {"project_dir": "/work/project", "home": "/home/user"}


def test_fitting_globs_equal_the_standard_library():
    r = random.Random(4)
    word = lambda k: "".join(r.choice(["a", "b", "/", ".", "é", "*", "?", "[ab]", "[!a]", "[", "]", "[]a]", "\n"]) for _ in range(r.randint(0, k)))
    globs = {n: word(6) for n in range(400)}
    made = Globs(globs)
    for _ in range(800):
        text = "".join(r.choice("ab/.é[]\n") for _ in range(r.randint(0, 6)))
        assert made.fitting(text) == {n for n, glob in globs.items() if fnmatch.fnmatchcase(text, glob)}


def test_equals_the_scan_of_each_rule(spark):
    r = random.Random(6)
    part = lambda: "".join(r.choice(["a", "b", ".env", "/", "*", "?", "[ab]", "src", "é"]) for _ in range(r.randint(1, 5)))
    rules = [Rule(f"g{n}", path_pattern=r.choice(["", "/", "~/"]) + part(), action=r.choice(["block", "warn"]), target=r.choice(["both", "llm"]), tool=r.choice([None, "Bash"])) for n in range(60)]
    rules += [Rule("text", "a"), Rule("dot", path_pattern="."), Rule("home", path_pattern="~/*", replacement="R", action="redact")]
    path = lambda: r.choice(["", "/", "~/", "../", "/work/project/"]) + "".join(r.choice(["a", "b", ".env", "/", "src", "é"]) for _ in range(r.randint(0, 5)))
    rows = [(n, [path() for _ in range(r.randint(0, 3))], r.choice(["llm", "tool"]), r.choice(["Bash", "Read", None])) for n in range(150)]
    df = spark.createDataFrame([*rows, (150, None, "llm", "Bash"), (151, ["/work/project", None, "/", ""], None, None)], "id int, paths array<string>, channel string, tool string").repartition(3)
    one, other = (f(df, rules, "paths", channel=F.col("channel"), tool=F.col("tool"), **PLACE).orderBy("id").collect() for f in (scan_paths, scan_path_catalogue))
    assert one == other and sum(len(x.path_matches) for x in one) > 50
    assert scan_path_catalogue(df, [], "paths").first().path_matches == []


def test_ten_thousand_globs(spark):
    df = spark.range(2_000).select(F.array(F.format_string("/srv/data/%d/file.%d", "id", "id")).alias("paths"))
    sizes = []
    for n in (9, 10_000):
        rules = [Rule(f"r{i}", path_pattern=[f"/srv/data/{i}/*", f"*.{i}", f"*/{i}/f*"][i % 3]) for i in range(n)]
        began = time.time()
        found = scan_path_catalogue(df, rules, "paths", **PLACE)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        assert found.agg(F.sum(F.size("path_matches"))).first()[0] == min(n, 2_000)
        assert time.time() - began < 30
    assert abs(sizes[0] - sizes[1]) < 50
    globs = Globs(dict(enumerate(f"*.{i}" for i in range(10_000))))
    assert globs.fitting("/srv/x.4711") == {4711} and globs.tested <= 2
