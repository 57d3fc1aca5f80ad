"""Rows of the suffix tree's scores: repeated and null ids, equal texts, clashing columns."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import suffix_tree


def test_each_row_is_scored_by_its_own_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MOST", 3)  # most words meet their counts in the join
    rows = [(1, "red blue red"), (1, "red blue red"), (1, "green once only"), (None, "red unseen word"), (None, None), (2, "blue blue green"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "n": F.lit(2), "key": F.lit(3)})
    train = df.where("doc_id is not null and doc_id < 3")
    counts = Counter(w for i, t in rows if i in (1, 2) for w in suffix_tree.words_of(t))
    total, distinct = sum(counts.values()), len(counts)

    def want(i, t):
        own = suffix_tree.words_of(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        return -1 if i is None else i, len(own), sum(counts[w] > 0 for w in own), total, round(base, 9)

    got = suffix_tree.score(df, "doc_id", "text", suffix_tree.fit(train, "text")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == sorted(want(i, t) for i, t in rows)
    same = [r.score for r in got if round(r.base_score, 9) == want(1, "red blue red")[-1]]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["Red  blue\tRED", None, "", " \x00 a\x00 \x0b\x00", "\u00c4ra\u00a0x \u4f60\u597d", "end", "x" * 3_000 + " y\n"]
    want = [suffix_tree.words_of(x) for x in texts]
    for part, own in ((pa.array(texts, pa.string()), want), (pa.array(texts, pa.string()).slice(2, 3), want[2:5]), (pa.array([], pa.string()), [])):
        lines, flat = suffix_tree.Lines(part), [w for x in own for w in x]
        assert lines.words(suffix_tree.np.arange(len(lines.hash))) == flat and lines.sizes.tolist() == [len(x) for x in own]
        assert lines.hash.tolist() == suffix_tree.hashes_of(flat).tolist()
        assert lines.owner.tolist() == [k for k, x in enumerate(own) for _ in x] and lines.place.tolist() == [i for x in own for i in range(len(x))]
