import random
import time

import numpy as np

from sieveline.llm import toxicity

INSULTS = ["moron", "idiot", "stupid", "trash", "loser"]


def test_disguises_are_read(spark):
    said = [" ".join(w for _ in range(20) for w in (*INSULTS, "asshole", "ass", "boo", "shit", "the", "well", "known", "good", "coffee"))]
    reader = toxicity.Reader(toxicity.CharacterModel(toxicity.trigram_counts(spark.createDataFrame([(t,) for t in said], "text string"))))
    meant = {
        "a$$": "ass", "a55": "ass", "b00": "boo", "@$$hole": "asshole", "455hole": "asshole", "a$$!": "ass",
        "shi7.": "shit", "(shi7)": "shit", "!diot": "idiot", "+rash": "trash", "iiddiioott": "idiot", "id.iot": "idiot", "st-upid": "stupid",
        "i d i o t": "idiot", "i d ! o t": "idiot", "$ t u p i d": "stupid", "1 d 1 0 t": "idiot", "(i d i o t)": "idiot", "i  d  i  o  t": "idiot", "1.d.1.0.t": "idiot",
    }
    for seen, word in meant.items():
        found, n = reader.words(f"the {seen} the")
        # a stand-in written twice may be read as one letter or as two
        assert n == 1 and (found == ["the", word, "the"] or (word == "asshole" and found[1] == "ashole")), (seen, found)
    for plain in ("well-known", "good coffee", "1 2 3 4", "the good. the"):
        assert reader.words(plain) == (toxicity._WORD.findall(plain), 0), plain
    assert reader.words("a1." * 20_000)[0]


def test_rare_insults_are_learned_however_many_rows_there_are(spark):
    toxic = [(f"a{n} moron b{n}" + (f" c{n} wretch d{n}" if n < 6 else ""), 1) for n in range(1_000)]
    clean = [(f"a{n} fine b{n}", 0) for n in range(2_000)]
    weights = toxicity.fit(spark.createDataFrame(toxic + clean, "text string, toxic int")).weights
    assert weights["wretch$"] > 1 and weights["moron$"] > 1 and "fine$" not in weights


def all_readings(model, seen, breaks):
    """Every way to read ``seen``, with its probability: plain recursion, nothing is left out."""
    best = (float("-inf"), "")

    def go(at, a, b, p, word):
        nonlocal best
        if at == len(seen):
            best = max(best, (p + model.log[a][b][0], word))
            return
        c, before = seen[at], seen[at - 1] if at else ""
        drop = toxicity._DROPPED if c in toxicity._SEPARATORS else toxicity._REPEATED if c == before else toxicity._LOST if c in toxicity._INDEX else toxicity._NOISE
        go(at + 1, a, b, p + drop, word)
        if breaks and c in toxicity._BREAKS:
            go(at + 1, 0, 0, p + toxicity._SAME + (model.log[a][b][0] if b else 0.0), word + " ")
        stands = [(c, toxicity._SAME)] if c in toxicity._INDEX else [(x, toxicity._MASKED if c == "*" else toxicity._STANDS_FOR) for x in (toxicity.LETTERS if c == "*" else toxicity.LEET.get(c, ""))]
        for x, cost in stands:
            n = toxicity._INDEX[x]
            go(at + 1, b, n, p + cost + model.log[a][b][n], word + x)

    go(0, 0, 0, 0.0, "")
    return best[1]


def every_state(model, seen, breaks):
    """The likeliest reading by going on from every pair of last letters, none left out and no run cut."""
    states = {(0, 0): (0.0, "")}
    for at, c in enumerate(seen):
        before = seen[at - 1] if at else ""
        drop = toxicity._DROPPED if c in toxicity._SEPARATORS else toxicity._REPEATED if c == before else toxicity._LOST if c in toxicity._INDEX else toxicity._NOISE
        stands = [(c, toxicity._SAME)] if c in toxicity._INDEX else [(x, toxicity._MASKED if c == "*" else toxicity._STANDS_FOR) for x in (toxicity.LETTERS if c == "*" else toxicity.LEET.get(c, ""))]
        following = {}
        for (a, b), (p, word) in states.items():
            ways = [((a, b), p + drop, word)] + [((b, toxicity._INDEX[x]), p + cost + model.log[a][b][toxicity._INDEX[x]], word + x) for x, cost in stands]
            if breaks and c in toxicity._BREAKS:
                ways.append(((0, 0), p + toxicity._SAME + (model.log[a][b][0] if b else 0.0), word + " "))
            for key, q, longer in ways:
                if key not in following or following[key][0] < q:
                    following[key] = (q, longer)
        states = following
    return max((p + model.log[a][b][0], word) for (a, b), (p, word) in states.items())


def sparse_model(seed):
    size, rng = len(toxicity.LETTERS) + 1, np.random.default_rng(seed)
    return toxicity.CharacterModel(rng.integers(0, 3_000, (size, size, size)) * (rng.random((size, size, size)) < 0.03) * 1.0)


def test_decoding_finds_the_best_of_all_readings():
    rng = random.Random(3)
    for n in range(400):
        model = sparse_model(n % 4) if n < 4 or n % 100 == 0 else model
        seen = "".join(rng.choices("abest01$!|.-_ 4 aab", k=rng.randint(1, 6))) if n % 4 else rng.choice(["a*", "*b", "t*1", "**", "a*s", "s**t"])
        for breaks in (False, True):
            assert model.decode(seen, breaks) == all_readings(model, seen, breaks) == every_state(model, seen, breaks)[1], seen


def test_no_state_and_no_mask_that_could_win_is_left_out():
    rng, model = random.Random(4), sparse_model(9)
    for n in range(300):
        seen = "".join(rng.choices("abest01$!|.-_4tuidox", k=rng.randint(7, 30)))
        # two readings may be equally likely
        assert abs(model.likeliest(seen, n % 2 == 0)[0] - every_state(model, seen, n % 2 == 0)[0]) < 1e-6, seen
    for seen in ("m****n", "i*i*t", "s***id", "." * 90 + "a1", "$$$$$$$$a", "a......b!!!!!!"):
        assert abs(model.likeliest(seen, True)[0] - every_state(model, seen, True)[0]) < 1e-6, seen
    cut, whole = "a" + "*" * model._masks + "b", "a" + "*" * (model._masks + 8) + "b"
    assert model.decode(whole) == model.decode(cut) == every_state(model, whole, False)[1]


def test_long_tokens_take_their_length():
    size = len(toxicity.LETTERS) + 1
    model = toxicity.CharacterModel(np.random.default_rng(3).integers(0, 30, (size, size, size)) * 1.0)
    began = time.time()
    for token in ("a*" * 400, "*" * 100_000, "a1" * 5_000):
        model.decode(token, True)
    assert time.time() - began < 20


def test_shortcuts_find_what_the_patterns_find():
    rng = random.Random(6)
    texts = ["".join(rng.choices("aaabbé œß²ª1 0 @$!|+€*..--__  '\"([{)\t\n　\x85\xa0中😀:;,", k=rng.randint(0, 14))) for _ in range(30_000)]
    for text in [*texts, "a b c " * 20_000, "oo" * 50_000, "-" * 50_000]:
        assert toxicity.written_words(text) == toxicity._WORD.findall(text)
        single, repeated = toxicity._hints(text)
        assert single or not (toxicity._SPACED_OUT.search(text) or toxicity._SPACED_MIXED.search(text)), text
        assert {m.start() for m in toxicity._REPEATED_LETTER.finditer(text)} <= set(repeated), text
