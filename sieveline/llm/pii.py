"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their kind's validation are permuted within their
format by a Feistel network under a key: a card number becomes another card
number with a right check digit, a date another date, written alike. Equal
values get equal pseudonyms in all documents, and no table has to be kept: who
has the key can undo the permutation.

A value is split into two numbers, ``left`` below ``a`` and ``right`` below
``b``. Each round adds a keyed hash of one to the other, modulo its bound, so
the pairs are permuted whatever the bounds are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
#: Days of four centuries from 1800-01-01 on: 189 * 773, so every pair of the two is a day.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def round_key(key: str, kind: str) -> str:
    """The key that a kind's hashes use; the given key doesn't show in plans."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, round_: Column, value: Column, bound: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), round_.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), bound)


def feistel(left: Column, right: Column, a, b, key: str, undo: bool = False) -> Column:
    """``struct<l, r>``: the permuted pair, ``l`` below ``a`` and ``r`` below ``b``."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("bigint"), b.cast("bigint")
    sign = -1 if undo else 1

    def step(pair: Column, n: Column) -> Column:
        l, r = pair["l"], pair["r"]  # noqa: E741
        even = F.struct(F.pmod(l + sign * _hash(key, n, r, a), a).alias("l"), r.alias("r"))
        odd = F.struct(l.alias("l"), F.pmod(r + sign * _hash(key, n, l, b), b).alias("r"))
        return F.when(n % 2 == 0, even).otherwise(odd)

    rounds = range(ROUNDS)
    return F.aggregate(F.array(*(F.lit(n) for n in (reversed(rounds) if undo else rounds))), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(digits: Column, start, length) -> Column:
    return F.coalesce(F.substring(digits, start, length).cast("bigint"), F.lit(0).cast("bigint"))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _rewrite(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, acc["at"] + 1).otherwise(acc["at"]).alias("at"))

    return F.aggregate(F.split(value, ""), state, step, lambda acc: acc["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, with 9 taken off what exceeds it; the last isn't doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def _card_valid(value: Column) -> Column:
    return _let(_digits(value), lambda d: (F.length(d).between(13, 19)) & (_luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"))


def _card(value: Column, key: str, undo: bool) -> Column:
    """The first digit and the length stay; the check digit is made anew."""

    def made(d: Column) -> Column:
        n = F.length(d) - 2  # digits between the first and the check digit
        half = F.floor(n / 2).cast("int")
        a, b = F.pow(F.lit(10.0), half).cast("bigint"), F.pow(F.lit(10.0), n - half).cast("bigint")
        pair = feistel(_number(d, F.lit(2), half), _number(d, half + 2, n - half), a, b, key, undo)
        body = _let(pair, lambda p: F.concat(F.substring(d, 1, 1), F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))
        return _let(body, lambda x: F.concat(x, F.pmod(-_luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return _rewrite(value, _let(_digits(value), made))


def _card_class(lengths: Column) -> Column:
    """Which windows of groups of digits are taken first: 0 for cards as they are usually written, 1 for longer ones, 2 for other groupings."""
    usual = (F.size(lengths) == 1) | lengths.isin(*(F.array(*map(F.lit, x)) for x in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))))
    return F.when(usual, 0).when(lengths == F.array(*map(F.lit, (4, 4, 4, 4, 3))), 1).otherwise(2)


def _cards(run: Column, key: str, undo: bool) -> Column:
    """``struct<text, n>``: a run of digits in groups with the cards in it permuted, and their number.

    Cards begin and end at a separator or an end of the run. Usual groupings
    come before others, then those further left, then longer ones.
    """
    def windows(groups: Column) -> Column:
        def from_(at: Column) -> Column:
            def of(n: Column) -> Column:
                part = F.slice(groups, at + 1, n)
                digits = F.array_join(part, "")
                return F.struct(F.when(F.length(digits).between(13, 19), _card_class(F.transform(part, F.length))).alias("kind"), at.alias("at"), (-n).alias("less"), digits.alias("digits"))

            return F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - at)), of), lambda w: w["kind"].isNotNull())

        all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), from_))
        return F.array_sort(F.filter(all_, lambda w: _card_valid(w["digits"])))

    def chosen(sorted_: Column, n: Column) -> Column:
        """A byte for each group: "." if it is in no card, "c" if it goes on with one, else "@" plus the groups of the card that it starts."""

        def step(marks: Column, w: Column) -> Column:
            free = F.replace(F.substring(marks, w["at"] + 1, -w["less"]).cast("string"), F.lit("."), F.lit("")) == ""
            card = F.concat(F.char(64 - w["less"]), F.repeat(F.lit("c"), -w["less"] - 1)).cast("binary")
            return F.when(free, F.overlay(marks, card, w["at"] + 1, -w["less"])).otherwise(marks)

        return F.aggregate(sorted_, F.repeat(F.lit("."), n).cast("binary"), step)

    def glued(groups: Column, marks: Column) -> Column:
        separators = F.concat(F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))

        def joined(separator: Column) -> Column:
            def piece(group: Column, at: Column) -> Column:
                mark = F.substring(marks, at + 1, F.lit(1)).cast("string")
                n = F.ascii(mark) - 64
                written = F.array_join(F.transform(F.slice(groups, at + 1, n), lambda g, k: F.concat(g, F.when(k < n - 1, separator[at + k]).otherwise(""))), "")
                return F.when(mark == ".", F.concat(group, separator[at])).when(mark == "c", "").otherwise(F.concat(_card(written, key, undo), separator[at + n - 1]))

            return F.array_join(F.transform(groups, piece), "")

        return F.struct(_let(separators, joined).alias("text"), F.length(F.regexp_replace(marks.cast("string"), "[.c]", "")).alias("n"))

    def of(groups: Column) -> Column:
        return _let(chosen(windows(groups), F.size(groups)), lambda marks: glued(groups, marks))

    return _let(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), of)


def _phone_valid(value: Column) -> Column:
    return _let(_digits(value), lambda d: d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"))


def _phone(value: Column, key: str, undo: bool) -> Column:
    """The country code stays; area and exchange stay what such codes may be."""

    def made(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        right = (_number(ten, 4, 3) - 200) * 10_000 + _number(ten, 7, 4)
        pair = feistel(_number(ten, 1, 3) - 200, right, 800, 8_000_000, key, undo)
        return _let(pair, lambda p: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _padded(p["l"] + 200, 3), _padded(F.floor(p["r"] / 10_000) + 200, 3), _padded(p["r"] % 10_000, 4)))

    return _rewrite(value, _let(_digits(value), made))


def _ip_valid(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255))


def _ip(value: Column, key: str, undo: bool) -> Column:
    part = lambda x, n: x[n].cast("bigint")
    pair = _let(F.split(value, r"\."), lambda x: feistel(part(x, 0) * 256 + part(x, 1), part(x, 2) * 256 + part(x, 3), 65_536, 65_536, key, undo))
    text = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
    return _let(pair, lambda p: F.concat_ws(".", text(p["l"]), text(p["r"])))


def _ssn_valid(value: Column) -> Column:
    return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _ssn(value: Column, key: str, undo: bool) -> Column:
    area = _number(value, 1, 3)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(left, (_number(value, 5, 2) - 1) * 9_999 + _number(value, 8, 4) - 1, 898, 99 * 9_999, key, undo)
    return _let(pair, lambda p: F.concat_ws("-", _padded(p["l"] + 1 + F.when(p["l"] > 664, 1).otherwise(0), 3), _padded(F.floor(p["r"] / 9_999) + 1, 2), _padded(p["r"] % 9_999 + 1, 4)))


#: Ways to write a date; the first that gives a date of the four centuries counts.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy")
#: Written with slashes, a day up to 12 is read as a month. Days from the 13th on are permuted among themselves: 9 * 9833 in four centuries.
DAY_FIRST, LATE_DAYS = "dd/MM/yyyy", (9, 9833)


def _dates(value: Column) -> list[tuple[Column, str]]:
    shape = lambda p: "^" + "".join("[0-9]" if c.isalpha() else "[.]" if c == "." else c for c in p) + "$"
    return [(F.when(value.rlike(shape(p)), F.try_to_timestamp(value, F.lit(p)).cast("date")), p) for p in DATE_PATTERNS]


def _first_day() -> Column:
    return F.to_date(F.lit(FIRST_DAY))


def _in_range(day: Column) -> Column:
    return day.between(_first_day(), F.date_add(_first_day(), DAYS[0] * DAYS[1] - 1))


def _date_valid(value: Column) -> Column:
    return F.coalesce(F.greatest(*(F.coalesce(_in_range(day), F.lit(False)) for day, _ in _dates(value))), F.lit(False))


def _months(day: Column) -> Column:
    """Whole months from the first day's to this one's."""
    return (F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day) - 1


def _late_day(n: Column) -> Column:
    """The ``n``-th of the days from the 13th of a month on."""

    def month(k: Column) -> Column:
        start = F.add_months(_first_day(), k.cast("int"))
        return F.struct((F.datediff(start, _first_day()) - 12 * k).alias("before"), start.alias("start"))

    # months have 16 to 19 such days, the four centuries' mean is 18.44; no month lies two off
    guess = F.floor(n * 4800 / (LATE_DAYS[0] * LATE_DAYS[1]))
    near = F.filter(F.transform(F.sequence(guess - 2, guess + 2), month), lambda m: m["before"] <= n)
    return _let(F.array_max(near), lambda m: F.date_add(m["start"], (n - m["before"] + 12).cast("int")))


def _date(value: Column, key: str, undo: bool) -> Column:
    out = F.lit(None).cast("string")
    for day, pattern in reversed(_dates(value)):
        n = F.datediff(day, _first_day()).cast("bigint")
        if pattern == DAY_FIRST:
            n, sizes, kind = n - 12 * (_months(day) + 1), LATE_DAYS, round_key(key, pattern)
        else:
            sizes, kind = DAYS, key
        pair = feistel(F.floor(n / sizes[1]), n % sizes[1], *sizes, kind, undo)
        number = _number_of(pair, sizes[1])
        made = _let(number, _late_day) if pattern == DAY_FIRST else F.date_add(_first_day(), number.cast("int"))
        out = F.when(_in_range(day), F.date_format(made, pattern)).otherwise(out)
    return out


def _number_of(pair: Column, size: int) -> Column:
    return _let(pair, lambda p: p["l"] * size + p["r"])


def _email(value: Column, key: str, undo: bool) -> Column:
    """Letters and digits before the "@" become others of their class: each half is shifted by a hash of the other."""
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def shifted(part: Column, by: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            code, n = F.ascii(c), F.conv(F.substring(by, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * (-1 if undo else 1)
            turn = lambda first, size: F.chr(F.pmod(code - first + n, F.lit(size)) + first)
            return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(pair: Column, n: Column) -> Column:
        l, r = pair["l"], pair["r"]  # noqa: E741
        by = lambda x: F.sha2(F.concat_ws("|", F.lit(key), n.cast("string"), x), 256)
        return F.when(n % 2 == 0, F.struct(shifted(l, by(r)).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), shifted(r, by(l)).alias("r")))

    order = range(ROUNDS)
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    pair = F.aggregate(F.array(*(F.lit(n) for n in (reversed(order) if undo else order))), start, step, lambda p: F.concat(p["l"], p["r"]))
    return F.concat(pair, F.substring(value, F.length(local) + 1, F.length(value)))


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds candidates, ``valid`` says which count, ``permute(value, key, undo)`` gives the pseudonym.

    Where a candidate may hold several values or foreign parts,
    ``inside(value, key, undo)`` takes the place of both.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    permute: Callable[[Column, str, bool], Column]
    inside: Callable[[Column, str, bool], Column] | None = None


def _anywhere(pattern: str) -> str:
    """``pattern`` without its conditions on what stands before."""
    return re.sub(r"\(\?<!\[[^]]*\]\)", "", pattern)


_OTHERS = (
    # sizes are the standard's: 64 characters before the "@", labels of 63, 127 of them at most
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}", lambda v: F.lit(True), _email),
    Kind("date", r"(?<![0-9A-Za-z.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![0-9A-Za-z])", _date_valid, _date),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn_valid, _ssn),
    Kind("phone", r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:\+?1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", _phone_valid, _phone),
    Kind("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", _ip_valid, _ip),
)
#: Groups of digits, 13 or more; a group that another kind's candidate begins with isn't in the run.
_CARDS = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -](?!" + "|".join(_anywhere(kind.pattern) for kind in _OTHERS) + r")[0-9]++(?![A-Za-z]))*+"
#: In the order in which they are tried at a place.
KINDS = (*_OTHERS, Kind("card", _CARDS, _card_valid, _card, _cards))


def pseudonymize(docs: DataFrame, key: str, kinds=KINDS, undo: bool = False, text_column: str = "text") -> DataFrame:
    """``docs`` with the values of all ``kinds`` in ``text_column`` permuted, and ``n_<kind>`` counts.

    Candidates are found left to right without overlap; one that fails its
    kind's validation stays as it is. In a run of digits in groups every card
    is found, whatever numbers stand beside it. Of a mail address what stands
    before the "@" is permuted, its domain stays. A null text stays null with
    counts of zero, an empty one empty; repeated rows are treated alike; an
    empty table stays empty. The time grows with a text's length, whatever it
    holds. Different values written alike get different pseudonyms; a value
    may be its own, as in any permutation. With ``undo`` and the same key the
    values come back, but for runs of digits in which a pseudonym makes
    another grouping look like a card. Columns named like the counts are
    replaced; other columns may have any names.
    """
    (hits_name,) = unused(docs, "hits")
    text = F.col(text_column)
    found_by = "|".join(f"(?:{kind.pattern})" for kind in kinds)
    whole = [f"^(?:{_anywhere(kind.pattern)})$" for kind in kinds]

    def as_found(kind: str, made: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), made.alias("text"), n.cast("int").alias("n"))

    def inside(kind: str, x: Column) -> Column:
        return as_found(kind, x["text"], x["n"])

    def pseudonym(value: Column) -> Column:
        out = as_found("", value, F.lit(0))
        for kind, pattern in reversed(list(zip(kinds, whole, strict=True))):
            if kind.inside:
                made = _let(kind.inside(value, round_key(key, kind.name), undo), lambda x: inside(kind.name, x))
            else:
                valid = F.coalesce(kind.valid(value), F.lit(False))
                made = as_found(kind.name, F.when(valid, kind.permute(value, round_key(key, kind.name), undo)).otherwise(value), valid)
            out = F.when(value.rlike(pattern), made).otherwise(out)
        return out

    none = F.array().cast("array<struct<kind:string,text:string,n:int>>")
    hits = F.when(text.rlike("[0-9]|@"), F.transform(F.regexp_extract_all(text, F.lit(found_by), F.lit(0)), pseudonym)).otherwise(none)
    staged = docs.withColumn(hits_name, hits)
    glued = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, found_by, -1).alias("gap"), F.col(hits_name).alias("hit")), lambda x: F.array(x["gap"], F.coalesce(x["hit"]["text"], F.lit(""))))), "")

    def count(kind: Kind) -> Column:
        counted = F.aggregate(F.filter(hits_name, lambda h: h["kind"] == kind.name), F.lit(0), lambda n, h: n + h["n"])
        return F.when(F.col(hits_name).isNull(), 0).otherwise(counted).cast("bigint")

    return staged.withColumns({**{f"n_{kind.name}": count(kind) for kind in kinds}, text_column: F.when(F.size(hits_name) > 0, glued).otherwise(text)}).drop(hits_name)
