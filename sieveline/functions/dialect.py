"""Python regular expressions for Spark's Java engine.

A pattern is parsed by the standard library and written anew, element by
element, so that Java finds what Python would. What has no exact counterpart
gives ``None``; such patterns run in Python (see ``spans``).
"""

from __future__ import annotations

import fnmatch
import re
from re import _constants as op
from re import _parser

#: Python's \w and \s for text, as Java character class bodies.
WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_CLASSES = {op.CATEGORY_DIGIT: r"\p{Nd}", op.CATEGORY_WORD: WORD, op.CATEGORY_SPACE: SPACE}
_NOT = {op.CATEGORY_NOT_DIGIT: r"\P{Nd}", op.CATEGORY_NOT_WORD: f"[^{WORD}]", op.CATEGORY_NOT_SPACE: f"[^{SPACE}]"}
_PLACES = {
    op.AT_BEGINNING: r"\A",
    op.AT_BEGINNING_STRING: r"\A",
    op.AT_END: r"(?=\n?\z)",
    op.AT_END_STRING: r"\z",
    op.AT_BOUNDARY: f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    op.AT_NON_BOUNDARY: f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
}


#: Java follows a repeat of a branch, or of a group of varying length, by recursion, one level for each turn. Patterns that may go deeper run in Python.
DEPTH = 200


class _Unsupported(Exception):
    pass


def _character(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and (c.isalnum() or c == "_") else f"\\x{{{code:X}}}"


def _members(items) -> str:
    negated = items[0][0] is op.NEGATE
    out = []
    for kind, value in items[negated:]:
        if kind is op.LITERAL:
            out.append(_character(value))
        elif kind is op.RANGE:
            out.append(f"{_character(value[0])}-{_character(value[1])}")
        elif kind is op.CATEGORY and value in _CLASSES:
            out.append(_CLASSES[value])
        elif kind is op.CATEGORY and value in _NOT and not negated:
            out.append(_NOT[value])
        else:
            raise _Unsupported(kind)
    return f"[{'^' * negated}{''.join(out)}]"


_SIGNS = {(0, op.MAXREPEAT): "*", (1, op.MAXREPEAT): "+", (0, 1): "?"}
_ONE_CHARACTER = {op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN}


def _even(nodes) -> bool:
    """Whether the elements match in one way only, of one length: Java repeats them without recursion."""
    return all(
        kind in _ONE_CHARACTER
        or (kind is op.AT)
        or (kind is op.SUBPATTERN and _even(value[-1]))
        or (kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == value[1] and _even(value[2]))
        for kind, value in nodes
    )


def _repeated(low, high, inner, lazy: bool, depth: int) -> str:
    if not _even(inner):
        depth *= DEPTH + 1 if high is op.MAXREPEAT else max(1, high)
        if depth > DEPTH:
            raise _Unsupported(inner)
    single = len(inner) == 1 and inner[0][0] in _ONE_CHARACTER
    count = _SIGNS.get((low, high)) or f"{{{low},{'' if high is op.MAXREPEAT else high}}}"
    written = _write(inner, depth)
    return (written if single else f"(?:{written})") + count + "?" * lazy


def _write(nodes, depth: int = 1) -> str:
    return "".join(_element(kind, value, depth) for kind, value in nodes)


def _element(kind, value, depth: int) -> str:
    if kind is op.LITERAL:
        return _character(value)
    if kind is op.NOT_LITERAL:
        return f"[^{_character(value)}]"
    if kind is op.ANY:
        return r"[^\n]"
    if kind is op.IN:
        return _members(value)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        return _repeated(*value, kind is op.MIN_REPEAT, depth)
    if kind is op.SUBPATTERN:
        group, added, removed, inner = value
        if added or removed:
            raise _Unsupported(kind)
        return f"({'' if group else '?:'}{_write(inner, depth)})"
    if kind is op.BRANCH:
        return "(?:" + "|".join(_write(part, depth) for part in value[1]) + ")"
    if kind is op.AT and value in _PLACES:
        return _PLACES[value]
    if kind in (op.ASSERT, op.ASSERT_NOT):
        behind = "<" if value[0] < 0 else ""
        return f"(?{behind}{'=' if kind is op.ASSERT else '!'}{_write(value[1], depth)})"
    if kind is op.GROUPREF:
        return f"(?:\\{value})"
    raise _Unsupported(kind)


def to_java(pattern: str) -> str | None:
    """The Java pattern that finds the same matches, or None.

    None also for patterns that can match nothing (Spark's ``split`` and
    ``regexp_extract_all`` don't agree on empty matches) and for those that
    could end Java's stack on a long match (``DEPTH``).
    """
    parsed = _parser.parse(pattern)
    flags = parsed.state.flags & ~re.UNICODE
    if flags & ~re.IGNORECASE or parsed.getwidth()[0] == 0:
        return None
    try:
        return ("(?iu)" if flags else "") + _write(parsed)
    except _Unsupported:
        return None


def _longest(nodes) -> str:
    """The longest run of literal characters that the elements can't match without."""
    found, run = [], ""
    for kind, value in nodes:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        found, run = [*found, run], ""
        if kind is op.SUBPATTERN:
            found.append("" if value[1] & re.IGNORECASE else _longest(value[-1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            found.append(_longest(value[2]))
    return max([*found, run], key=len)


def matches_nothing(pattern: str) -> bool:
    """Whether a Python pattern can match an empty text."""
    return _parser.parse(pattern).getwidth()[0] == 0


def needed(pattern: str) -> str:
    """A text that every match of a Python pattern holds; empty if none is known."""
    parsed = _parser.parse(pattern)
    return "" if parsed.state.flags & re.IGNORECASE else _longest(parsed)


def literal(text: str) -> str:
    """A Python pattern for ``text`` itself."""
    return re.escape(text)


def glob_to_java(glob: str) -> str:
    """A glob for a whole path: ``*`` and ``?`` also stand for "/", ``[...]`` and ``[!...]`` are classes."""
    return "^" + fnmatch.translate(glob).replace(r"\Z", r"\z")


def _holds_newline(kind, value, flags: int) -> bool:
    """Whether an element that stands for one character can be a line's end."""
    if kind is op.LITERAL:
        return value == 10
    if kind is op.NOT_LITERAL:
        return value != 10
    if kind is op.ANY:
        return bool(flags & re.DOTALL)
    inside = False
    for what, member in value:
        if what is op.LITERAL:
            inside |= member == 10
        elif what is op.RANGE:
            inside |= member[0] <= 10 <= member[1]
        elif what is op.CATEGORY:
            inside |= member in (op.CATEGORY_SPACE, op.CATEGORY_NOT_DIGIT, op.CATEGORY_NOT_WORD)
    return inside != (value[0][0] is op.NEGATE)


def _parts(nodes, flags: int):
    """All elements of a pattern, inner ones too, each with the flags that hold there."""
    for kind, value in nodes:
        yield kind, value, flags
        if kind is op.SUBPATTERN:
            yield from _parts(value[-1], (flags | value[1]) & ~value[2])
        elif kind in _REPEATS:
            yield from _parts(value[2], flags)
        elif kind is op.BRANCH:
            for branch in value[1]:
                yield from _parts(branch, flags)
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            yield from _parts(value[1], flags)
        elif kind is op.ATOMIC_GROUP:
            yield from _parts(value, flags)
        elif kind is op.GROUPREF_EXISTS:
            for branch in value[1:]:
                yield from _parts(branch or (), flags)


_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def within_line(pattern: str) -> bool:
    """Whether no match of a Python pattern, nor what it looks at around it, can go on beyond a line's end."""
    parsed = _parser.parse(pattern)
    return not any(kind in _ONE_CHARACTER and _holds_newline(kind, value, flags) for kind, value, flags in _parts(parsed, parsed.state.flags))


def reach(pattern: str) -> int | None:
    """The most characters that a match of a Python pattern and what it looks at around it can span; None if there is no bound."""
    parsed = _parser.parse(pattern)
    widths = [parsed.getwidth()[1]] + [value[1].getwidth()[1] for kind, value, _ in _parts(parsed, 0) if kind in (op.ASSERT, op.ASSERT_NOT)]
    return None if sum(widths) >= op.MAXREPEAT else sum(widths)
