"""Conversations as training text with a loss flag for each segment.

A declarative template names the marks around each role's text and the roles
whose text is trained on. A finite-state machine over the roles says which
turn may follow which. Control strings inside texts are escaped, so the marks
stay unambiguous and the turns can be read back from the output alone.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = "struct<text string, loss boolean>"


@dataclass(frozen=True)
class Template:
    """``marks``: role -> (mark before, mark after). ``trained``: roles under the loss mask.

    A role without marks is written between ``other``'s first two marks, its
    text up to the third. No mark may hold a backslash or another mark, and no
    end of a mark may be the start of one: so no mark arises where texts and
    marks meet, nor across turns, and a conversation can be read turn by turn.
    """

    marks: dict = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[ROLE]", "[/ROLE]", "[/TURN]")
    trained: frozenset = frozenset({"assistant"})
    #: state -> states that may follow; the state is the last role, "" at the start.
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: states in which a conversation may end
    ends: frozenset = frozenset({"assistant"})

    def __post_init__(self):
        marks = self.controls()
        for a in marks:
            if not a or "\\" in a:
                raise ValueError(f"a mark must hold a character, and no backslash: {a!r}")
            for b in marks:
                if (a != b and a in b) or any(b.startswith(a[n:]) for n in range(1, len(a))):
                    raise ValueError(f"the marks {a!r} and {b!r} can't be told apart")
        if len(set(marks)) < len(marks):
            raise ValueError("two marks are alike")

    def controls(self) -> list[str]:
        return [*(mark for pair in self.marks.values() for mark in pair), *self.other]

    def _escapes(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.controls()])))

    def escape(self, text: str) -> str:
        """A backslash goes behind the first character of every control string; backslashes are doubled."""
        return self._escapes().sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn as (segment, loss flag)."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [(before, False), (self.escape(text), role in self.trained), (after, False)]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text."""
        of = {before: role for role, (before, _) in self.marks.items()}
        pieces = re.split("(" + "|".join(map(re.escape, self.controls())) + ")", formatted)
        found, at = [], 1
        while at < len(pieces):
            if pieces[at] == self.other[0]:
                role, at = self.unescape(pieces[at + 1]), at + 2
            else:
                role = of[pieces[at]]
            found.append((role, self.unescape(pieces[at + 1])))
            at += 4
        return found


def format_turns(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, n, valid, segments`` for every turn, a conversation's turns in order in one partition.

    ``n`` counts a conversation's turns from 0; ``valid`` is false where the
    state machine allows no such turn. Turns go by ``turn``, then role, then
    text; null roles and texts count as empty; rows without a conversation id
    are one conversation. Rows stream through: a conversation of any length
    needs the memory of one batch.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("valid", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])

    def run(batches):
        current, n, state = object(), 0, ""
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv_id != current:
                    current, n, state = conv_id, 0, ""
                out.append({"conv_id": conv_id, "n": n, "valid": role in template.follows.get(state, ()), "segments": [{"text": t, "loss": loss} for t, loss in template.segments(role, text)]})
                n, state = n + 1, role
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id bigint, n bigint, valid boolean, segments array<{SEGMENT}>")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation with what its formatted turns say.

    Takes ``format_turns``'s rows in their order and parses the joined
    segments again; nothing of the input is used.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches):
        current, started = None, False
        for batch in batches:
            done = []
            for conv_id, n, valid, segments in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if n == 0:
                    if started:
                        done.append(current.row())
                    current, started = _Conversation(conv_id, template), True
                current.add(valid, segments)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if started:
            yield pa.RecordBatch.from_pylist([current.row()], schema=schema)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


class _Conversation:
    """Running figures of one conversation."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.last = True, ""

    def add(self, valid: bool, segments: list[dict]) -> None:
        formatted = "".join(s["text"] for s in segments)
        self.chars += len(formatted)
        for role, text in self.template.turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns, self.last = self.n_turns + 1, role
        for s in segments:
            if s["loss"]:
                text = self.template.unescape(s["text"])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.valid &= valid

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.valid and self.last in self.template.ends}


#: DuckDB: the figures of all conversations and conversation -7 under the default template, without formatting anything.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
             length(text) + len(regexp_extract_all(text, '\\\\|\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[/TURN\]'))
             + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id
"""
