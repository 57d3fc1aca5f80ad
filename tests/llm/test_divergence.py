"""The audit against its SQL and against trees of plain Python."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import divergence as D


def same(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("item", F.lit("clash")).withColumn("term", F.lit(1)).repartition(parts)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in D.audit(df).collect()]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert sorted(got) == sorted(duck.execute(D.ORACLE).fetchall())
    return got


def test_audit_equals_sql(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Über", "ÜBER", "naïve", "x", "日本"]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["big"] * 4 + ["a", "b", "c", None, "é"])
        text = " ".join(rng.choice(words[: 20 + 5 * len(source or "")]).title() + rng.choice(["", ",", "9", "'s"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, lang, source))
    rows += [(1, rows[1][1], "en", "a")] * 12 + [(900, None, "en", "nothing"), (901, "", "xx", "p"), (902, "12 3!", "xx", "q"), (903, "alone " * 30, "solo", "one")]
    got = same(spark, rows)
    assert ("xx", "p", "pair", "q", 0, 1) in got and not [r for r in got if r[0] == "solo"]


def test_no_rows_and_one_long_text(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(df).count() == 0
    long = [(i, "abc def " * (400_000 if i == 3 else 5), "en", f"s{i % 2}") for i in range(12)]
    same(spark, long)
    assert [len(x) for x in D.words(b"ab " * 1_000_000)] == [333_334, 333_334, 333_332]


def test_tree_sums_equal_all_pairs():
    rng = random.Random(7)
    for _ in range(30):
        many, terms = rng.randint(1, 6), 50
        rows = sorted({tuple((s, rng.randint(1, 3)) for s in range(many) if rng.random() < 0.6) for _ in range(25)} - {()})
        m = np.array([rng.randint(1, 9) for _ in rows], np.int64)
        totals = [rng.randint(0, 500) for _ in range(many)]
        wide = max(map(len, rows))
        source, n = (np.array([[x[k] for x in r] + [-1] * (wide - len(r)) for r in rows], np.int64) for k in (0, 1))
        a, b, value = D.tree_sums(source, n, np.array([len(r) for r in rows]), m, totals, terms)
        got = dict(zip(zip(a.tolist(), b.tolist()), value.tolist()))
        p = lambda s, c: 1 + 10**9 * (c + 2) // (totals[s] + 2 * terms)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for i in range(many):
            for j in range(i + 1, many):
                want = sum(int(k) * (f(p(i, dict(r).get(i, 0)), p(j, dict(r).get(j, 0))) - f(p(i, 0), p(j, 0))) for r, k in zip(rows, m))
                assert got.get((i, j), 0) == want


def test_shares_beyond_64_bits():
    n, total = np.array([10**12, 5]), np.array([3 * 10**12, 3 * 10**12])
    assert D.shares(n, total, 7).tolist() == [1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 14), 1 + 10**9 * 7 // (3 * 10**12 + 14)]
