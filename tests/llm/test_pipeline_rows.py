"""The pipeline's stages against brute force, with repeated ids, equal texts, clashing columns and a long text."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 25, 80, 200]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(3, rows[3][1]), (3, "another text of the same id"), (None, "no id here"), (900, " ".join(word() for _ in range(20_000))), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "h": F.lit(1), "pred": F.lit("x"), "score": F.lit(0), "grp": F.lit(2), "spans": F.lit("y")})


def test_near_copies_keep_one_of_each_group(spark, docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    left = [{rows[i][0] for i in range(len(rows)) if group[i] == g and sets[i]} for g in set(group)]
    want = sorted(min(x) for x in left if x) + sorted(-1 if i is None else i for (i, t), s in zip(rows, sets) if not s)
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("h <> 1 or pred <> 'x' or score <> 0 or grp <> 2 or spans <> 'y'").count() == 0
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(want)


def test_language_and_benchmark_rows(spark, docs, tmp_path):
    item = docs.where("doc_id = 900").first().text.split()
    spark.createDataFrame([("b", " ".join(item)), (None, "no id here")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spoken = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert spoken.columns == docs.columns and spoken.where("pred <> 'x' or score <> 0").count() == 0
    assert spoken.count() == docs.where("text is not null and text <> ''").count()
    kept = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or -1, r.text or "") for r in docs.exceptAll(kept).collect()) == sorted([(-1, "no id here"), (900, " ".join(item))])


def test_scanner_of_repeated_and_overlapping_windows():
    items = [("a", "x y z " * 8), ("b", "q " + "x y z " * 6), ("c", "one"), ("d", "x y z x y")]
    tables = decontaminate.scanners(items)
    words = decontaminate.words_of("p one x y z x y z x y z x y z x y q")
    hit, found = set(), set()
    for table in tables:
        table.scan(words, hit, found)
    want_hit, want = set(), set()
    for name, text in items:
        w = decontaminate.words_of(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    want_hit |= set(range(j, j + m))
                    want.add(name)
    assert (hit, found) == (want_hit, want)
