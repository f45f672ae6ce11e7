"""From matches to decisions: reasons, the rewritten text, the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pseudonyms
from ..functions.spans import let, running
from .scan import no_matches


def _is(action: str):
    return lambda m: F.coalesce(m["action"] == action, F.lit(False))


def _redacts(m: Column) -> Column:
    """Any action but block and warn rewrites."""
    return ~F.coalesce(m["action"].isin("block", "warn"), F.lit(False))


def reasons(matches: Column, action: str) -> Column:
    """One reason for each match of ``action``, in their order."""
    return F.transform(F.filter(matches, _is(action)), lambda m: m["reason"])


def replacement_of(match: Column) -> Column:
    """A match's replacement by its rule, as an expression over the match."""
    out = F.when(match["replacement"].isNull(), F.lit(pseudonyms.REDACTED))
    for kind, generator in pseudonyms.GENERATORS.items():
        out = out.when(match["replacement"] == kind, generator(match["text"]))
    return out.otherwise(match["replacement"])


def splice(text: Column, matches: Column, replacement=replacement_of) -> Column:
    """``text`` with the matches' spans replaced, from the last start to the first.

    Offsets are those of the original text throughout, so overlapping spans
    may take away more than their union.
    """
    keyed = F.array_sort(F.transform(matches, lambda m, i: F.struct(m["start"].alias("start"), i.alias("i"), m["end"].alias("end"), replacement(m).alias("by"))))

    def either(sorted_: Column) -> Column:
        before = lambda i: F.get(sorted_, i - 1)
        meets = F.transform(sorted_, lambda m, i: (i > 0) & ((before(i)["end"] > m["start"]) | (before(i)["start"] == m["start"])))
        return F.when(F.exists(meets, lambda x: x), _spliced_in_turn(text, sorted_)).otherwise(_spliced_apart(text, sorted_))

    return let(keyed, either)


def _cutter(wide: Column):
    """A function of a start and a number of characters that cuts them out of a text.

    ``wide`` is the text in a form with four bytes for each character, where a
    place is found without reading what stands before it. A cut may begin with
    what a decoder would take for a byte order mark, so it is read with a
    space before it.
    """
    space = F.encode(F.lit(" "), "UTF-32")
    return lambda start, n: F.substring(F.decode(F.concat(space, F.substring(wide, start * 4 + 1, n * 4)), "UTF-32"), F.lit(2), n)


def _wide_length(wide: Column) -> Column:
    return F.floor(F.octet_length(wide) / 4).cast("int")


def _spliced_in_turn(text: Column, sorted_: Column) -> Column:
    """Overlapping spans: each replacement works on what the later ones left.

    A replacement whose end lies behind the start of the one before cuts into
    what that one and those before it made. How long the made part is after
    each turn is the larger of a constant and the length before it plus
    another, so lengths are merged by :func:`running`; of the piece that a turn
    puts in front, the rear stays that no later cut reaches. Pieces are then
    cut once and joined once, however the spans overlap.
    """
    longest = lambda a, b: F.struct(F.greatest(b["least"], a["least"] + b["more"]).alias("least"), (a["more"] + b["more"]).alias("more"))

    def spliced(wide: Column) -> Column:
        cut, n = _cutter(wide), _wide_length(wide)
        order = F.array_sort(F.transform(sorted_, lambda m: F.struct((-m["start"]).alias("back"), m["i"].alias("i"), m["start"].alias("start"), m["end"].alias("end"), m["by"].alias("by"))))

        def turns(ms: Column) -> Column:
            """For each match where the one before starts, how far it cuts into what is made, and the characters that it puts in front."""
            before = lambda i: F.coalesce(F.get(ms, i - 1)["start"], n)
            return F.transform(
                ms,
                lambda m, i: F.struct(
                    m["start"].alias("start"),
                    m["end"].alias("end"),
                    m["by"].alias("by"),
                    before(i).alias("up_to"),
                    F.greatest(F.lit(0), m["end"] - before(i)).alias("into"),
                    (F.length(m["by"]) + F.greatest(F.lit(0), before(i) - m["end"])).alias("size"),
                ),
            )

        def joined(ts: Column) -> Column:
            # the made part's length after a turn is max(size, length before - into + size)
            lengths = F.transform(running(F.transform(ts, lambda t: F.struct(t["size"].alias("least"), (t["size"] - t["into"]).alias("more"))), longest), lambda x: x["least"])
            kept = lambda length: F.transform(ts, lambda t, i: F.greatest(F.lit(0), F.coalesce(F.get(length, i - 1), F.lit(0)) - t["into"]))

            def pieces(length: Column, left: Column) -> Column:
                # the least that any later turn leaves of the made part
                later = F.reverse(running(F.reverse(left), lambda a, b: F.least(a, b)))

                def piece(t: Column, i: Column, later: Column) -> Column:
                    rear = F.greatest(F.lit(0), F.least(length[i], F.coalesce(F.get(later, i + 1), length[i])) - left[i])
                    gone = t["size"] - rear
                    by = F.substring(t["by"], gone + 1, F.length(t["by"]))
                    start = t["end"] + F.greatest(F.lit(0), gone - F.length(t["by"]))
                    return F.concat(by, cut(start, F.greatest(F.lit(0), t["up_to"] - start)))

                made = let(later, lambda later: F.transform(ts, lambda t, i: piece(t, i, later)))
                return F.concat(cut(F.lit(0), F.least(n, F.element_at(ts, -1)["start"])), F.array_join(F.reverse(made), ""))

            return let(lengths, lambda length: let(kept(length), lambda left: pieces(length, left)))

        return let(let(order, turns), joined)

    return let(F.encode(text, "UTF-32"), spliced)


def _spliced_apart(text: Column, sorted_: Column) -> Column:
    """Spans that don't touch: the text between them and the replacements, joined once."""

    def joined(wide: Column) -> Column:
        cut = _cutter(wide)
        end = lambda i: F.coalesce(F.get(sorted_, i - 1)["end"], F.lit(0))
        pieces = F.transform(sorted_, lambda m, i: F.concat(cut(end(i), m["start"] - end(i)), m["by"]))
        last = F.element_at(sorted_, -1)["end"]
        rest = F.greatest(F.lit(0), _wide_length(wide) - last)
        return F.concat(F.array_join(pieces, ""), cut(last, rest))

    return let(F.encode(text, "UTF-32"), joined)


def decide(df: DataFrame, text_column: str = "text", matches: str = "matches", known: str | None = None) -> DataFrame:
    """``df`` with ``decision, block_reasons, warn_reasons, redacted_text, redact_ids``.

    block before redact before warn before allow. A blocked row has no
    redacted text. ``known`` names a map column from "rule id, newline, value"
    to replacements that were given before and hold.
    """
    found = F.coalesce(F.col(matches), no_matches())
    text = F.coalesce(F.col(text_column), F.lit(""))

    def replacement(m: Column) -> Column:
        made = replacement_of(m)
        return F.coalesce(F.try_element_at(F.col(known), F.concat_ws("\n", m["rule_id"], m["text"])), made) if known else made

    blocked = F.exists(found, _is("block"))
    redacted = F.filter(found, _redacts)
    decision = F.when(blocked, "block").when(F.size(redacted) > 0, "redact").when(F.size(found) > 0, "warn").otherwise("allow")
    return df.withColumns(
        {
            "decision": decision,
            "block_reasons": reasons(found, "block"),
            "warn_reasons": reasons(found, "warn"),
            "redacted_text": F.when(~blocked, F.when(F.size(redacted) > 0, splice(text, redacted, replacement)).otherwise(F.col(text_column))),
            "redact_ids": F.array_join(F.transform(F.filter(found, _is("redact")), lambda m: m["rule_id"]), ", "),
        }
    )


def redact(df: DataFrame, rules: list, text_column: str = "text", **options) -> DataFrame:
    """``scan`` and ``decide`` in one; the text column is rewritten where the decision is redact."""
    from .scan import scan

    out = decide(scan(df, rules, text_column, **options), text_column)
    rewritten = F.when(F.col("decision") == "redact", F.col("redacted_text")).otherwise(F.col(text_column))
    return out.withColumn(text_column, rewritten).select(*df.columns, "decision")
