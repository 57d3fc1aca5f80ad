"""Every word of every text goes through the fold of higher-order functions, whatever its frequency, and ids equal the library's."""

import random

import public_tokenizers
import tiktoken

from riskloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_rare_words_are_folded_too(spark, monkeypatch):
    """22,000 words, more than a table of frequent ones held."""
    rng, fold, seen = random.Random(3), bpe.folded, []
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 9))) for _ in range(24_000)})[:22_000]
    docs = spark.createDataFrame([(i, " ".join(words[i::40])) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(bpe, "folded", lambda df, column, path: seen.append(df.select(column)) or fold(df, column, path))
    out = {r.doc_id: r.ids for r in bpe.encode(docs, "doc_id", "text", RANKS).collect()}
    folded = {bytes(word).decode().strip() for row in seen[0].collect() for word in row[0]}
    assert folded == set(words) and len(seen) == 1
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    assert out == {i: encoder.encode_ordinary(" ".join(words[i::40])) for i in range(40)}


def test_numbers_begin_anew_and_long_words_keep_their_places(spark):
    """Ids named like the columns between the steps; few numbers at a time; words too long to fold among short, repeated and absent ones."""
    rng = random.Random(5)
    pick = [lambda: "x" * rng.randint(250, 900), lambda: "é" * rng.randint(120, 200), lambda: rng.choice(["the", "über", "日本語", "😀"]), lambda: "".join(rng.choice("abcé") for _ in range(6))]
    texts = [None, "", *(" ".join(rng.choice(pick)() for _ in range(rng.randint(0, 40))) for _ in range(60)), "\x1c  \n" * 300, "z" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "Words long, text string").repartition(2)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    for numbered in (0, 50, bpe.NUMBERED):
        with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            rows = bpe.encode(docs, "Words", "text", RANKS, "decoded", numbered).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
        assert {r.Words: r.ids for r in rows} == {i: encoder.encode_ordinary(x or "") for i, x in enumerate(texts)}
        assert {r.Words: bytes(r.decoded).decode() for r in rows} == {i: x or "" for i, x in enumerate(texts)}


def test_the_rank_map_is_never_a_column_of_rows(spark):
    """A projection that holds the map would copy megabytes into every row."""
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = bpe.encode(docs, "doc_id", "text", RANKS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") == 1 and "_ranks" not in plan
