"""Sketches whose counts are too large to bound an overlap."""

import duckdb

from riskloom.llm import jaccard_join


def test_saturated_sketches_drop_no_pair(spark):
    full, low = b"\xff\xff" * 64, b"\x01\x00" * 64
    sets = spark.createDataFrame([(1, 5_000_000, full), (2, 5_000_001, full), (3, 5_000_000, low)], "rep long, n long, sketch binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in jaccard_join.possible(pairs, sets).collect()] == [(1, 2)]


def test_rows_without_id_count_their_shingles_and_link_with_nothing(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D e f"), (None, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.group(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 3, None), (None, 3, None), (1, 3, 1), (2, 3, 1), (None, 0, None), (3, 1, 3)], key=str)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(duck.execute(jaccard_join.ORACLE).fetchall(), key=str) == got
    assert jaccard_join.keep_one(df, "doc_id", "text").count() == 5
