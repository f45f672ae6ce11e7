import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import dialect
from sieveline.operators.large_files import _cut, range_spans, scan_files
from sieveline.operators.scan import matches, scan
from sieveline.sources.files import text_files
from sieveline.sources.rules import Rule, hashed_rule

LINES = ["aa", "[a-z]+@x", "^a", "b$", r"\Aa", r"a\Z", r"\bab\b", "(?<=a)b+", "a(?!b)", "é+|😀", "(?m)^b", "b*", "(?:ab|c)+", "a(?=[^\n]*c)", "a.c"]
ACROSS = [r"[a\n]a", "a\nb", r"a\s?b", r"(?s)a.{0,3}c", "[^c]{1,4}", r"(a|\n){2}", r"a(?=\nb)", r"(?<=\n)b", r"\s\s", r"(?m)a$\n", r"\n"]
WHOLE = [r"a\s+b", "(?s)a.*c", r"\s*", "[^a]+"]
RULES = [Rule(p, p) for p in LINES + ACROSS + WHOLE] + [Rule("literal", "b\nc", is_regex=False), hashed_rule("ab", "hashed", hash_extractor="[abc]+")]


def spans_of(text, cut):
    import hashlib

    found = [(m.start(), m.end(), m.group()) for m in re.finditer(cut.pattern, text)]
    return [s for s in found if cut.digest in (None, hashlib.sha256(s[2].encode()).hexdigest())]


def test_which_rules_need_whole_files():
    assert all(_cut(0, Rule("r", p)).reach is None for p in LINES)
    assert all(_cut(0, Rule("r", p)).reach for p in ACROSS)
    assert all(_cut(0, Rule("r", p)) is None for p in [*WHOLE, "(?s).{5000}"])
    assert dialect.reach(r"ab(?=cd?)") == 4 and dialect.reach("a+") is None and dialect.within_line(r"[^\n\r]+") and not dialect.within_line(r"\W")


def test_spans_are_those_of_the_file_for_every_seam():
    r = random.Random(5)
    cuts = [c for n, rule in enumerate(RULES) if (c := _cut(n, rule))]
    for _ in range(60):
        data = "".join(r.choice(["a", "a", "b", "c", "é", "😀", "@x", "\n", "\r", "\r\n", " "]) for _ in range(r.randint(0, 30))).encode()
        text = data.decode().replace("\r\n", "\n").replace("\r", "\n")
        for size in [*range(1, 8), 13, 40]:
            before, found = 0, {}
            for begin in range(0, max(1, len(data)), size):
                part = range_spans(io.BytesIO(data), len(data), begin, min(begin + size, len(data)), cuts, more=r.choice([1, 3, 50]))
                for s in part["spans"]:
                    found.setdefault(s["ord"], []).append((s["start"] + before, s["end"] + before, s["text"]))
                before += part["n_chars"]
                assert part["valid"]
            assert before == len(text)
            assert {c.ord: found.get(c.ord, []) for c in cuts} == {c.ord: spans_of(text, c) for c in cuts}, (data, size)


def test_what_is_not_utf8_is_seen_in_some_range():
    for data in (b"ab\xff", b"\x80a", b"a\xe2\x82", b"\xf0\x9f\x98\x80\x80a", b"a\xed\xa0\x80", b"\x80" * 9):
        for size in range(1, 6):
            parts = [range_spans(io.BytesIO(data), len(data), at, min(at + size, len(data)), [], 1)["valid"] for at in range(0, len(data), size)]
            assert not all(parts), (data, size)


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_files_are_scanned_as_their_texts(spark, tmp_path, size):
    folder = tmp_path / "in"
    (folder / "deep er").mkdir(parents=True)
    r = random.Random(8)
    for name in ("a.txt", "deep er/b %41é.txt", "c.txt"):
        (folder / name).write_bytes("".join(r.choice(["a", "b", "c", "é", "😀", "ab@x", "\n", "\r\n", " "]) for _ in range(60)).encode())
    (folder / "empty.txt").write_bytes(b"")
    (folder / "bad.txt").write_bytes(b"aa ab@x \xff aa\n" * 3)
    (folder / "other.bin").write_bytes(b"aa")
    rules = [x for x in RULES if x.pattern != "b*"] + [Rule("llm", "a", target="llm"), Rule("bash", "a", tool="Bash", action="redact", replacement="R")]
    columns = ["path", "ord", "rule_id", "action", "reason", "replacement", "start", "end", "text", "segment_hash"]
    expected = matches(scan(text_files(spark, str(folder), "*.txt"), rules, tool=F.lit("Bash")), ["path"]).select(columns)
    found = scan_files(spark, str(folder), rules, tool="Bash", glob="*.txt", size=size)
    place = {rule.id: n for n, rule in enumerate(rules)}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    assert all(place[x.rule_id] == x.ord for x in found.collect())


def test_a_line_longer_than_ranges(spark, tmp_path):
    (tmp_path / "long.txt").write_text("x" * 300_000 + "y" + "z" * 300_000 + "\nxyz\n")
    found = scan_files(spark, str(tmp_path), [Rule("r", "x+yz+")], size=50_000).collect()
    assert [(m.start, m.end) for m in sorted(found, key=lambda m: m.start)] == [(0, 600_001), (600_002, 600_005)]
