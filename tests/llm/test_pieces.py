"""Pieces against the sentencepiece library: whole texts, random texts, ids of any kind."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from riskloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    table = pieces.tables(PATH)
    ids, begin = pieces.encoded(table, texts)
    for text, i, j in zip(texts, begin, begin[1:]):
        want = library.encode(text or "", add_eos=True)
        assert ids[i:j].tolist() == want
        assert table.decode(ids[i:j]) == library.decode(want)


def test_random_texts(library):
    rng = random.Random(5)
    for alphabet in ("abcdefgh   ▁▁ENTth.,!?0123éü世界\n\t\x00😀͸", "ab ", "aab", "  \n\tx", "=-=-*# ", "the in of "):
        same(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(300)])


def test_odd_texts(library):
    same(library, ["", None, "  ", " a  b", "a\x00b", "�", "▁x", "<s> </s> <0x0A>", " " * 3000 + "x" + " " * 37, "a" * 1000, "ab" * 900, "͸" * 5, "x" * 60_000 + " y"])


def test_long_text_in_slices(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 500)
    rng = random.Random(3)
    words = ["the", "of", "über", "world's", "x" * 700, "  ", "\n"]
    same(library, [" ".join(rng.choice(words) for _ in range(900)), "y" * 3000, "short", " " * 2000])


def test_rounds_equal_the_heap():
    table, rng = pieces.tables(PATH), random.Random(9)
    texts = ["".join(rng.choice("aeinrst▁") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    codes = [table.letter[np.frombuffer(t.encode("utf-32-le"), np.uint32)].astype(np.int64) for t in texts]
    starts = np.cumsum([0, *map(len, codes)])[:-1]
    flat, begin = table.merged(np.concatenate(codes), starts)
    for own, i, j in zip(codes, begin, [*begin[1:], len(flat)]):
        assert flat[i:j].tolist() == table.long(own.tolist())


def test_any_ids_decode_as_the_library_does(library):
    table, rng = pieces.tables(PATH), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.choice([0, 1, 2, 28705, 2287, 229, 153, 132])]) for _ in range(rng.randint(0, 12))]
        assert table.decode(np.array(ids, np.int32)) == library.decode(ids)
    assert pieces.utf8(b"\xff" * 5000) == "�" * 5000


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x▁y"), (4, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = pieces.encode(df, "doc_id", "text", PATH, "decoded")
    got = sorted((tuple(r) for r in pieces.digest(out, "doc_id").collect()), key=str)
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_eos=True)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((key, len(ids), *sums))
    assert got == sorted(want, key=str)
    again = pieces.decode(out.drop("decoded").withColumn("kept", F.lit(1)), "ids", PATH)
    assert sorted(str(r.decoded) for r in again.collect()) == sorted((t or "").replace("▁", " ") for _, t in rows) and again.columns == ["doc_id", "ids", "kept", "decoded"]
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), "ids", PATH).first().decoded is None
    assert pieces.encode(df.where("false"), "doc_id", "text", PATH).count() == 0
