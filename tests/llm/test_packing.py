import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import packing, token_ids
from sieveline.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {(p, b): Encoder(p, b) for p, b in ((BYTES, "prefix"), (WORDS, "drop"), (BYTES, "none"), (WORDS, "none"))}
TEXTS = ["a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|>", None, "", " ", "a", "the cat. The dog!\nNext  line", "é ñandú ΑΣ 日本", "word " * 700, "x" * 5000, "don't <|endoftext|> 'S", "a", "a"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)] + [(1, "", "y"), (None, "no id", "z")], "doc_id long, text string, piece string")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abE \n\t.,'s!1é́日　\x1c\x85ſ", max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert ENCODERS[BYTES, "prefix"].encode(text) == ENCODERS[BYTES, "none"].encode(text)
    assert ENCODERS[WORDS, "drop"].encode(text) == ENCODERS[WORDS, "none"].encode(text)


def ids(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(part):
    return zlib.crc32(array("I", part).tobytes())


@pytest.mark.parametrize("open_bins", [1, 4, 256])
def test_pieces_and_places(spark, open_bins):
    df = rows(spark).repartition(3)
    found = [r.asDict() for r in packing.pack(df, BYTES, open_bins=open_bins, capacity=512).collect()]
    expected = []
    for doc_id, text, _ in rows(spark).collect():
        whole = ids(BYTES, text, 0)
        head = len(whole) % 512 or 512
        for n, start in enumerate([0, *range(head, len(whole), 512)]):
            part = whole[start : head if n == 0 else start + 512]
            expected.append((str(doc_id), n, start, len(part), crc(part)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 512


def test_few_sequences_and_merge_rounds(spark):
    lengths = np.random.default_rng(5).integers(1, 400, 3000)
    df = spark.createDataFrame([(n, "a " * int(k)) for n, k in enumerate(lengths)], "doc_id long, text string").repartition(40)
    found = packing.pack(df, BYTES, capacity=512, open_bins=32)
    total, used = found.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used * 512 < 1.03 * total
    assert found.count() == 3000


def test_ids_come_along(spark):
    for r in packing.pack(rows(spark), BYTES, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert packer.add(6, "a") == [] and packer.add(7, "b") == []
    assert packer.add(3, "c") == [[(7, "b"), (3, "c")]]
    assert packer.add(8, "d") == []
    assert packer.add(5, "e") == [[(8, "d")]]
    assert [free for free, _ in packer.flush()] == [4, 5]


def test_empty_tables(spark):
    empty = rows(spark).limit(0)
    assert packing.pack(empty, BYTES).count() == 0
    assert token_ids.token_ids(empty, WORDS).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_token_id_files(spark, tmp_path, width):
    df, path = rows(spark), str(tmp_path / "ids")
    token_ids.write_token_ids(df.repartition(4), path, WORDS, width=width, partitions=3)
    found = token_ids.read_token_ids(spark, path, with_ids=True).collect()
    start, expected = 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        whole = ids(WORDS, r.text, 1)
        expected.append((r.doc_id, start, len(whole), crc(whole), array("I", whole).tobytes()))
        start += len(whole)
    bare = lambda rows: sorted((str(r[0]), *r[2:]) for r in rows)
    assert bare(found) == bare(expected)
    found = sorted(map(tuple, found), key=lambda r: r[1])
    assert [r[1] for r in found] == [sum(r[2] for r in found[:n]) for n in range(len(found))]
    assert [r[0] for r in found] == [r[0] for r in expected]
    some = token_ids.look_up(spark, path, [1, 3, 99_999]).collect()
    assert sorted(map(tuple, some)) == sorted(r for r in found if r[0] in (1, 3)) and len(some) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 1 << 20))
def test_elias_fano(values, spare):
    values = sorted(values)
    universe = (values[-1] if values else 0) + spare
    coded = token_ids.EliasFano.from_bytes(token_ids.EliasFano.encode(values, universe).to_bytes())
    assert coded.decode().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values


def test_ids_beyond_the_doubles_stay_exact(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, "a b"), (None, "c d"), (big + 1, "e")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack(df, BYTES).collect()) == sorted([str(big), "None", str(big + 1)])


def test_rows_of_a_hot_id_are_spread(spark, tmp_path):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), (F.col("id") % 7).cast("string")).alias("text"))
    token_ids.write_token_ids(df, str(tmp_path / "ids"), WORDS, partitions=4)
    sizes = [r.n_docs for r in spark.read.parquet(str(tmp_path / "ids")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500
    assert token_ids.read_token_ids(spark, str(tmp_path / "ids")).count() == 4000


def test_special_strings_may_be_ordinary_text():
    text = "a <|endoftext|> b"
    assert len(Encoder(BYTES, "prefix", special=False).encode(text)) > len(Encoder(BYTES, "prefix").encode(text)) == 4 * len(ids(BYTES, text, 0)[:-1])


def test_elias_fano_is_small_and_selects_over_gaps():
    values = np.sort(np.r_[np.arange(1000), 10_000_000 + np.arange(1000)])
    coded = token_ids.EliasFano.encode(values, 10_001_000)
    assert [coded.select(i) for i in range(0, 2000, 37)] == values[::37].tolist()
    assert len(coded.to_bytes()) < 8 * len(values) / 3
    with pytest.raises(IndexError):
        coded.select(2000)
