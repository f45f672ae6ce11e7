"""Secret scans through a trigram index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: what any
match must contain. The trigrams of all queries are looked up in every text
once; the postings (document ids by trigram, in buckets of bounded size) are
intersected and united as the queries say. Only the candidates of a rule meet
its regex. A rule that has no mandatory trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as _op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let, placed, running
from ..operators.decide import splice
from .common import broadcast_if_small, materialize, text_or_empty, unused

#: Documents whose ids meet in one bucket of the index, about.
BUCKET_ROWS = 2_048
#: Candidates up to which their table is sent to all executors; a larger one is shuffled.
BROADCAST_ROWS = 100_000
#: Strings followed for one stretch of a regex; beyond it the stretch is cut.
STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` must be read alike by Python and Java; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A pattern that some match lies in if there is one that counts; cheaper to test than to extract.
    probe: str | None = None


#: Fixed patterns of the three base kinds.
BASE_RULES = (
    SecretRule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Formats of widely known services.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(node) -> set[str] | None:
    """All lower-case strings one element of a parsed regex can match, or None if they are too many."""
    kind, value = node
    if kind is _op.LITERAL:
        return {chr(value).lower()}
    if kind is _op.IN:
        if value[0][0] is _op.NEGATE or any(k not in (_op.LITERAL, _op.RANGE) for k, _ in value):
            return None
        codes = {c for k, v in value for c in (range(v[0], v[1] + 1) if k is _op.RANGE else [v])}
        return {chr(c).lower() for c in codes} if len(codes) <= 8 else None
    if kind is _op.SUBPATTERN:
        return _joined(value[-1])
    if kind is _op.BRANCH:
        parts = [_joined(part) for part in value[1]]
        return None if None in parts else set().union(*parts)
    if kind in (_op.MAX_REPEAT, _op.MIN_REPEAT):
        low, high, inner = value
        one = _joined(inner) if high is not _op.MAXREPEAT and high <= 4 else None
        if one is None:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)} if len(one) ** high <= STRINGS else None
    return None


def _joined(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses that must all hold; a clause is a choice of trigram lists, one of which must be there whole.

    An empty query: the regex has no mandatory trigram.
    """
    clauses, run = [], {""}

    def end_run() -> None:
        least = {s for s in run if not any(t != s and t in s for t in run)}
        if all(len(s) >= 3 for s in least):
            clauses.append(sorted([s[i : i + 3] for i in range(len(s) - 2)] for s in least))

    for node in _parser.parse(pattern):
        more = _strings(node)
        if more is None or len(run) * len(more) > STRINGS:
            end_run()
            run = more if more and len(more) <= STRINGS else {""}
        else:
            run = {a + b for a in run for b in more}
    end_run()
    return clauses


def postings(docs: DataFrame, trigrams: list[str], buckets: int) -> DataFrame:
    """``bucket, gram, ids``: the inverted index of ``docs (doc_id, text)`` for ``trigrams``, without case."""
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams))))
    rows = docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(found).alias("gram"))
    return rows.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id), {buckets})")).groupBy("bucket", "gram").agg(F.collect_set("doc_id").alias("ids"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, list]) -> DataFrame:
    """``doc_id, kinds``: documents that may hold a match, from the index alone."""
    number = {t: n for n, t in enumerate(trigrams)}
    none = F.array().cast("array<bigint>")
    both = lambda parts: parts[0] if len(parts) == 1 else F.array_intersect(parts[0], both(parts[1:]))
    either = lambda parts: parts[0] if len(parts) == 1 else F.array_union(parts[0], either(parts[1:]))
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(number[t])), none)
    hits = [F.struct(F.lit(kind).alias("kind"), both([either([both([of(t) for t in way]) for way in clause]) for clause in query]).alias("ids")) for kind, query in queries.items()]
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    pairs = lists.select(F.explode(F.array(*hits)).alias("hit")).select("hit.kind", F.explode("hit.ids").alias("doc_id"))
    return pairs.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """``array<struct<start, rank, end>>`` of a rule's matches that count, in code points."""
    hits, parts = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(n)) for n in (0, rule.group))
    pieces = let(hits, lambda h: F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(h)).alias("gap"), h.alias("hit")))
    counts = F.filter(F.arrays_zip(let(pieces, placed).alias("span"), parts.alias("part")), lambda x: F.length(x["part"]) >= rule.least)
    return F.transform(counts, lambda x: F.struct(x["span"]["start"].alias("start"), F.lit(rank).alias("rank"), x["span"]["end"].alias("end")))


def _with_spans(docs: DataFrame, rules, id_column: str, text_column: str, out: str) -> DataFrame:
    """``docs`` with a column ``out`` of spans; only ids and rule names are joined to it."""
    id_name, kinds_name = unused(docs, "id", "kinds")
    text = F.coalesce(F.col(text_column), F.lit(""))
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern))}
    trigrams = sorted({t for query in queries.values() for clause in query for way in clause for t in way})
    df, kinds, unknown = docs, F.array().cast("array<string>"), F.col(id_column).isNull()
    if queries:
        source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
        buckets = max(1, -(-docs.count() // BUCKET_ROWS))
        index = materialize(postings(source, trigrams, buckets), "trigrams")
        maybe = materialize(candidates(index, trigrams, queries), "candidates").select(F.col("doc_id").alias(id_name), F.col("kinds").alias(kinds_name))
        df = docs.join(broadcast_if_small(maybe, BROADCAST_ROWS), F.col(id_column).cast("bigint") == F.col(id_name), "left")
        kinds = F.coalesce(kinds_name, kinds)
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = []
    for rank, rule in enumerate(rules):
        wanted = (F.array_contains(kinds, rule.kind) | unknown) if rule.kind in queries else F.lit(True)
        wanted &= text.rlike(rule.probe or rule.pattern)
        found.append(F.when(wanted, _spans(text, rule, rank)).otherwise(nothing))
    return df.select(*docs.columns, F.array_sort(F.concat(*found)).alias(out))


def find_secrets(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, spans`` of every row; ``spans`` is ``array<struct<start, rank, end>>`` in order.

    ``rank`` is the rule's place in ``rules``, offsets are code points with an
    exclusive end, matches of one rule don't overlap. A null text is an empty
    one. Rows without an id aren't in the index and meet every rule. Repeated
    ids share their candidates. Texts of any length are read whole, in time in
    proportion to it, or nearly so, however many secrets they hold. An empty
    table gives an empty result; other columns are left out, whatever their
    names.
    """
    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return _with_spans(source, rules, "doc_id", "text", "spans")


def _joined_spans(spans: Column, rules) -> Column:
    names = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for every row."""
    found = find_secrets(docs, RULES, id_column, text_column)
    n = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined_spans(base, RULES), 256).alias("base_sha256"), _joined_spans(F.col("spans"), RULES).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap put together."""

    def of(reach: Column) -> Column:
        ends = lambda i: F.get(reach, i - 1)
        heads = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), ((i == 0) | (s["start"] >= ends(i))).alias("new"))), lambda h: h["new"])
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(h["start"].alias("start"), ends(F.coalesce(F.get(hs, k + 1)["i"], F.size(reach))).alias("end"))))

    return let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), of)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mask``; overlapping spans become one.

    Columns and rows stay, whatever their names; a null text stays null, an
    empty table empty. Texts of any length are read whole.
    """
    (spans,) = unused(docs, "spans")
    text = F.col(text_column)
    masked = let(_merged(F.col(spans)), lambda apart: splice(text, apart, lambda span: F.lit(mask)))
    found = _with_spans(docs, rules, id_column, text_column, spans)
    return found.select(*(F.when(F.size(spans) > 0, masked).otherwise(text).alias(c) if c == text_column else F.col(c) for c in docs.columns))


def _span_sql(rule: SecretRule, rank: int) -> str:
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, '{rule.kind}' AS kind, {rank} AS rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
FROM (SELECT r, unnest(range(1, len(m) + 1)) AS i, m, p, string_split_regex(text, {quoted}) AS g
      FROM (SELECT r, text, regexp_extract_all(text, {quoted}, 0) AS m, regexp_extract_all(text, {quoted}, {rule.group}) AS p FROM d)) WHERE length(p[i]) >= {rule.least}"""


SCAN_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_span_sql(rule, rank) for rank, rule in enumerate(RULES))}),
a AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
