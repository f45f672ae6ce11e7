"""Toxicity of texts, with a noisy-channel reading of disguised words.

A disguised word (leetspeak, spaced-out or repeated letters) is seen as the
output of a channel: each observed character may stand for a letter, or for
none. The readings of a token form a lattice of characters; Viterbi decoding
finds the likeliest one under a character trigram model that is counted over
the whole corpus. The restored text is then scored: by the words whose
beginnings speak most for the toxic label among the training rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from heapq import nlargest
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Letters of the character model, after lower-casing; index 0 is the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_INDEX = {c: n for n, c in enumerate(LETTERS, 1)}
#: Letters that a character is used for in place of.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
_SEPARATORS, _BREAKS = " .-_*", ".-_"
#: Log-probabilities of the channel.
_SAME, _STANDS_FOR, _DROPPED, _REPEATED, _MASKED, _NOISE, _LOST = -0.05, -1.2, -0.7, -0.9, -4.0, -8.0, -25.0

#: Labelled rows that the classifier is fitted on at most; of more, a share by hash of the id.
FIT_ROWS = 200_000
#: Word beginnings of these lengths, and whole words, are features.
BEGINNINGS = range(3, 9)
#: A feature occurs in so many toxic training rows and contexts at least.
LEAST = 4
#: Words of a text that its evidence is taken from.
TOP = 2
#: A table of features up to this size is sent to all executors.
BROADCAST_ROWS = 200_000

_STANDS = {c: tuple((_INDEX[x], x, _STANDS_FOR) for x in letters) for c, letters in LEET.items()}
_first = itemgetter(0)
_WORD = re.compile(r"[^\W\d_]+")
#: What gives a disguise away; the whole token around it is then read anew. Cheap to look for, as most texts have none.
_STAND_IN = re.compile(r"[0-9@$!|+€*]")
_AMONG_LETTERS = re.compile(r"[^\W\d_][0-9@$!|+€*]+[^\W\d_]|(?<![^\s\"'(\[{])[0-9@$!|+€]+[^\W\d_]|[^\W\d_][0-9@$|+€]+[.,;:?!\"')\]}]*(?!\S)")
_REPEATED_LETTER = re.compile(r"([^\W\d_])\1(?:\1|([^\W\d_])\2)")
_SEPARATED = re.compile(r"[.\-_](?<=[^\W\d_].)(?=[^\W\d_])")
_SPACED_OUT = re.compile(r"(?<![^\s\"'(\[{])[^\W_](?:(?: {1,3}|[.\-_*])[^\W_]){2,}(?![^\W_])")
_SPACED_MIXED = re.compile(r"(?<![^\s\"'(\[{])(?:[^\W_]|[@$!|+€])(?:(?: {1,3}|[.\-_*])(?:[^\W_]|[@$!|+€])){2,}(?![^\W_])")
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s")
#: Latin-1 with a space for whatever isn't a letter.
_SPACED = bytes(n if _WORD.match(chr(n)) else 32 for n in range(256))
#: Characters that may stand behind one of a run of single ones, and those before it, by code; white space has none above the last.
_BEHIND = np.array([chr(n) in _SEPARATORS for n in range(0x3002)])
_BEFORE = _BEHIND | np.array([chr(n) in "\"'([{" or bool(_SPACE.match(chr(n))) for n in range(0x3002)])


def written_words(text: str) -> list[str]:
    """What ``_WORD`` finds; texts of Latin-1 alone take a shorter way."""
    try:
        return text.encode("latin-1").translate(_SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def _hints(text: str) -> tuple[bool, list[int]]:
    """Whether two single characters follow each other, as in every run of them, and the places where repeated letters may start."""
    padded = f" {text} "
    try:
        codes = np.frombuffer(padded.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.minimum(np.frombuffer(padded.encode("utf-32-le"), np.uint32), len(_BEHIND) - 1)
    behind, same = _BEHIND[codes], codes[1:] == codes[:-1]
    single = _BEFORE[codes[:-2]] & ~behind[1:-1] & behind[2:]
    follows = any(bool((single[:-n] & single[n:]).any()) for n in (2, 3, 4))
    return follows, (np.flatnonzero(same[:-2] & (same[1:-1] | same[2:])) - 1).tolist()


def disguised(text: str) -> list[tuple[int, int, bool]]:
    """Spans of tokens that may be disguised words, left to right without overlap, and whether they are runs of single characters."""
    odd = _STAND_IN.search(text)
    single, repeated = _hints(text)
    runs = [m.span() for m in (_SPACED_MIXED if odd else _SPACED_OUT).finditer(text) if _LETTER.search(m[0])] if single else []
    spans = [(start, end, True) for start, end in runs]
    repeats = filter(None, (_REPEATED_LETTER.match(text, at) for at in repeated if at >= 0))
    for marks in (repeats, _SEPARATED.finditer(text), *([_AMONG_LETTERS.finditer(text)] if odd else [])):
        reached = 0
        for m in marks:
            start, end = m.span()
            if start < reached:
                continue
            while start and not text[start - 1].isspace():
                start -= 1
            behind = _SPACE.search(text, end)
            reached = end = behind.start() if behind else len(text)
            at = bisect_right(runs, (end, -1)) - 1
            if at < 0 or runs[at][1] <= start:
                spans.append((start, end, False))
    out: list[tuple[int, int, bool]] = []
    for span in sorted(spans):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


class CharacterModel:
    """Log-probability of a letter after two others, from trigram counts; sparse histories lean on shorter ones."""

    def __init__(self, counts: np.ndarray):
        one = counts.sum((0, 1)) + 0.5
        one = one / one.sum()
        two = counts.sum(0)
        two = (two + 4.0 * one) / (two.sum(1, keepdims=True) + 4.0)
        self._table = np.log((counts + 4.0 * two[None]) / (counts.sum(2, keepdims=True) + 4.0))
        self._size, self.log = len(self._table), self._table.tolist()
        self._rows = [row for rows in self.log for row in rows]
        # What a state may lose to any other by the next two letters, the last that it has a say in; letter 0 ends a word.
        after_next = (self._table.max(0)[None] - self._table).max(2)
        after_next[:, 0] = 0.0
        likeliest = self._table.max((0, 1))
        likeliest[0] = 0.0
        self._loss = (likeliest - self._table + after_next[None]).max(2).ravel().tolist()
        #: More letters for a run of masks cost more than any state may lose by dropping them.
        self._masks = math.ceil(max(self._loss) / (_DROPPED - _MASKED))
        self._mask_run = re.compile(rf"\*{{{self._masks + 1},}}")

    def decode(self, seen: str, breaks: bool = False) -> str:
        """The likeliest word behind ``seen``."""
        return self.likeliest(seen, breaks)[1]

    def likeliest(self, seen: str, breaks: bool = False) -> tuple[float, str]:
        """The likeliest reading's log-probability and word; with ``breaks`` a separator may also stand between two words, read as a space.

        No reading is left out: a state goes on unless another one is likelier
        by more than it may lose to any, and so would win whatever follows. Of
        a run of masks (``*``) as many are read as can stand for letters in a
        likeliest reading. A word is kept as a chain of letters, so time and
        memory grow with the length of ``seen``.
        """
        size, rows, loss = self._size, self._rows, self._loss
        # last two letters, as one number -> (log-probability, the last letter and the chain before it)
        states, before = {0: (0.0, None)}, ""
        for c in self._mask_run.sub("*" * self._masks, seen):
            index = _INDEX.get(c)
            drop = _DROPPED if c in _SEPARATORS else _REPEATED if c == before else _LOST if index else _NOISE
            if c == "*":
                following = self._masked(states)
            else:
                stands = ((index, c, _SAME),) if index else _STANDS.get(c, ())
                ends, following = breaks and c in _BREAKS, {}
                known = following.get
                for key, (p, chain) in states.items():
                    old = known(key)
                    if old is None or old[0] < p + drop:
                        following[key] = (p + drop, chain)
                    after, behind = rows[key], key % size * size
                    if ends:
                        q, old = p + _SAME + (after[0] if behind else 0.0), known(0)
                        if old is None or old[0] < q:
                            following[0] = (q, (" ", chain))
                    for n, letter, cost in stands:
                        q, old = p + cost + after[n], known(behind + n)
                        if old is None or old[0] < q:
                            following[behind + n] = (q, (letter, chain))
            states, before = following, c
            if len(states) > 1:
                p, best = max((p, key) for key, (p, _) in states.items())
                least = p - loss[best]
                states = {k: v for k, v in states.items() if v[0] >= least}
        (p, chain), letters = max(((p + rows[key][0], chain) for key, (p, chain) in states.items()), key=_first), []
        while chain:
            letters.append(chain[0])
            chain = chain[1]
        return p, "".join(reversed(letters))

    def _masked(self, states: dict) -> dict:
        """The states after a mask, which stands for any letter or for none; all letters at once, as one array."""
        size = self._size
        p = np.full(size * size, -np.inf)
        p[list(states)] = [q for q, _ in states.values()]
        reached = p.reshape(size, size, 1) + self._table
        came, reached = reached.argmax(0).ravel(), reached.max(0).ravel() + _MASKED
        reached[::size] = -np.inf
        following = {key: (q + _DROPPED, chain) for key, (q, chain) in states.items()}
        best = int(reached.argmax())
        for key in np.flatnonzero(reached >= reached[best] - self._loss[best]).tolist():
            q, old = float(reached[key]), following.get(key)
            if old is None or old[0] < q:
                behind, n = divmod(key, size)
                following[key] = (q, (LETTERS[n - 1], states[int(came[key]) * size + behind][1]))
        return following


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams, with word edges, over all words of ``docs (text)``.

    The counts of a partition are summed on the executors; the table that
    comes to the driver has at most a row for each trigram of ``LETTERS``.
    """
    size = len(LETTERS) + 1
    schema = pa.schema([("trigram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size**3, np.int64)
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0):
                words.update(written_words(text.as_py().lower()))
            joined = " " + "  ".join(words) + " "  # two edges before a word, one behind it
            codes = np.frombuffer(joined.translate(_CODES).encode("latin-1", "replace"), np.uint8).astype(np.int64)
            edges = codes == 0
            weight = np.fromiter(words.values(), np.int64, len(words))
            of = np.cumsum(edges[:-2] & ~edges[1:-1]) - 1 if len(words) else np.zeros(0, np.int64)
            key = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
            firsts = np.flatnonzero(edges[:-1] & ~edges[1:])
            valid = (codes[:-2] < size) & (codes[1:-1] < size) & (codes[2:] < size) & ~(edges[1:-1] & (edges[:-2] | edges[2:]))
            first = (firsts + 1)[codes[firsts + 1] < size]
            seen = np.concatenate([key[valid], codes[first]])
            times = np.concatenate([weight[of[valid]], weight[of[np.minimum(first - 1, len(of) - 1)]]])
            total += np.bincount(seen, times, size**3).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], schema=schema)

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n")).collect()
    counts = np.zeros(size**3, np.float64)
    for trigram, n in rows:
        counts[trigram] = n
    return counts.reshape(size, size, size)


class _Codes(dict):
    def __missing__(self, code: int) -> str:
        return "\xfe"


_CODES = _Codes({ord(" "): "\x00"} | {ord(c): chr(n) for c, n in _INDEX.items()})


class Reader:
    """Words of a text as they were meant; decoded tokens are remembered with the model, so by all tasks of a worker."""

    def __init__(self, model: CharacterModel, limit: int = 200_000):
        self.model, self.limit, self._known = model, limit, model.__dict__.setdefault("known", {})

    def _restore(self, token: str, run: bool) -> tuple[str, bool]:
        """What the token says, and whether that is other than what is written."""
        found = self._known.get((token, run))
        if found is None:
            if len(self._known) >= self.limit:
                self._known.clear()
            word = self.model.decode(token.strip(".,;:?\"'()[]{}"), not run)
            found = self._known[token, run] = (word, _WORD.findall(word) != _WORD.findall(token))
        return found

    def words(self, text: str) -> tuple[list[str], int]:
        """The restored text's words and how many of its tokens were restored to other words."""
        restored, at, n = [], 0, 0
        text = text.lower()
        for start, end, run in disguised(text):
            word, other = self._restore(text[start:end], run)
            restored += [text[at:start], " ", word, " "]
            at, n = end, n + other
        return written_words("".join(restored) + text[at:]), n


def features(word: str) -> list[str]:
    """A word and its beginnings; the word itself ends in "$"."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


@dataclass
class Classifier:
    """Weights of features; a text's score is a logistic function of its evidence."""

    weights: dict
    offset: float
    slope: float

    def __post_init__(self):
        self._starts = {f[: BEGINNINGS[0]] for f in self.weights}

    def weight(self, word: str) -> float:
        if word[: BEGINNINGS[0]] not in self._starts and (len(word) >= BEGINNINGS[0] or word + "$" not in self.weights):
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.offset + self.slope * evidence)))


def evidence(words, weight) -> float:
    """The sum of the ``TOP`` largest weights of different words: more would add up what chance puts into long texts."""
    return sum(nlargest(TOP, filter(None, map(weight, set(words)))))


def _feature_weight(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log-odds of a feature less what chance may add to it."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds - math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def restored(rows: DataFrame, model: CharacterModel) -> DataFrame:
    """``rows (text, toxic)`` with each text's restored words, joined by spaces, in its place."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(given.value)
        for batch in batches:
            texts = [" ".join(reader.words(text.as_py())[0]) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], names=["text", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "text string, toxic int")


def fit(rows: DataFrame) -> Classifier:
    """A classifier from ``rows (text, toxic)`` with restored texts.

    Candidates are the features of enough toxic rows; they are counted in the
    clean rows and weighed there, so that only telling ones come to the driver
    from a large vocabulary; those that speak for the label are weighed again by the number
    of different neighbours that they occur beside in toxic rows, so that the
    copies of one text don't make its words toxic.
    """
    sc = rows.sparkSession.sparkContext
    sizes = {int(t): n for t, n in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def counted(which: DataFrame, wanted=None, contexts: bool = False) -> DataFrame:
        def run(batches):
            kept = wanted.value if wanted else None
            known = _Known(kept)
            found: Counter | set = set() if contexts else Counter()

            def table():
                pairs = [(f, context, 1) for f, context in found] if contexts else [(f, "", n) for f, n in found.items()]
                for at in range(0, len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs[at : at + 100_000], strict=True)], names=["feature", "context", "n"])

            for batch in batches:
                if len(found) > 500_000:
                    yield from table()
                    found.clear()
                for text in batch.column(0):
                    words = text.as_py().split(" ")
                    if contexts:
                        padded = ["", *words, ""]
                        found.update((f, f"{a} {c}") for a, b, c in zip(padded, words, padded[2:], strict=False) for f in known[b])
                    else:
                        found.update(set(chain.from_iterable(map(known.__getitem__, set(words)))))
            yield from table()

        out = which.select("text").mapInArrow(run, "feature string, context string, n bigint")
        if contexts:
            return out.select("feature", "context").distinct().groupBy("feature").agg(F.count("*").alias("n"))
        return out.groupBy("feature").agg(F.sum("n").alias("n"))

    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    often = materialize(counted(toxic).where(F.col("n") >= LEAST), "often")
    wanted = sc.broadcast({f for (f,) in often.select("feature").collect()}) if often.count() <= BROADCAST_ROWS else None
    in_clean = counted(clean, wanted).withColumnRenamed("n", "clean")
    weighed = often.join(in_clean, "feature", "left").select("feature", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) - F.sqrt(1 / (F.col("n") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = {f: (n, c) for f, n, c in weighed.where(odds > 1).collect()}
    beside = dict(counted(toxic, sc.broadcast(set(telling)), True).collect())
    weights = {f: w for f, (n, c) in telling.items() if beside.get(f, 0) >= LEAST and (w := _feature_weight(min(n, beside[f]), c, n_toxic, n_clean)) > 1}
    return _calibrate(rows, Classifier(weights, 0.0, 0.0), (n_toxic + 0.5) / (n_toxic + n_clean + 2))


def _calibrate(rows: DataFrame, trained: Classifier, share: float) -> Classifier:
    """Offset and slope by logistic regression on counts of (evidence, label), drawn towards the toxic share."""
    given = rows.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        weights = _Weights(given.value)
        for batch in batches:
            found = [round(evidence(text.as_py().split(" "), weights.__getitem__), 1) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(run, "x double, toxic int").groupBy("x", "toxic").count().collect()
    x, y, n = (np.array(c, float) for c in zip(*table, strict=True)) if table else (np.zeros(0),) * 3
    prior = np.array([math.log(share / (1 - share)), 0.0])
    b = prior.copy()
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ b))
        slope = design.T @ (n * (y - p)) - 0.1 * (b - prior)
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(trained.weights, float(b[0]), float(b[1]))


def held_out(id_column: str = "doc_id"):
    """True for the fifth of the ids that no label is learned from."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_restored`` of every row of ``docs``.

    The character model reads all texts. The classifier learns from labelled
    rows that aren't held out, ``fit_rows`` of them at most, and from their
    texts alone. Null and empty texts hold no feature and get the score of
    such texts. Rows without a label, or with a null one, are scored but not
    learned from; of several labels of an id the highest counts. Repeated rows
    get the same score. A text, and a token in it, may have any length. Without
    any training row every score is one half or less; an empty table gives an
    empty result. Other columns are left out.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    model = CharacterModel(trigram_counts(source))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known, "labels")
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.expr(f"pmod(xxhash64(doc_id), 1000000) < {int(share * 1_000_000)}"))
    # ``fit_rows`` bounds the sample, so texts need no shuffle
    rows = source.join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = materialize(restored(rows, model), "training")
    given = docs.sparkSession.sparkContext.broadcast((model, fit(rows)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_restored", pa.int64())])

    def run(batches):
        model, classifier = given.value
        reader, weights = Reader(model), _Weights(classifier)
        for batch in batches:
            scores, restored = [], []
            for text in batch.column(2).to_pylist():
                words, n = reader.words(text)
                scores.append(classifier.score(evidence(words, weights.__getitem__)))
                restored.append(n)
            columns = [batch.column(0), batch.column(1), scores, [int(s >= 0.5) for s in scores], restored]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return source.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_restored bigint")


class _Known(dict):
    """Word -> its features, or those of them that are wanted, for the words met so far."""

    def __init__(self, wanted, limit: int = 300_000):
        super().__init__()
        self._wanted, self._limit = wanted, limit

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= self._limit:
            self.clear()
        found = self[word] = [f for f in features(word) if self._wanted is None or f in self._wanted]
        return found


class _Weights(dict):
    """Word -> weight, for the words met so far."""

    def __init__(self, classifier: Classifier, limit: int = 500_000):
        super().__init__()
        self._weight, self._limit = classifier.weight, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self._limit:
            self.clear()
        weight = self[word] = self._weight(word)
        return weight
