"""The pipeline's stages on small tables: what each drops, keeps and changes."""

import numpy as np
import pytest

import corpus_pipeline
from riskloom.llm import jaccard_join
from riskloom.llm.common import written


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(1, body, "en"), (2, body + " more", "en"), (3, None, "en"), (4, "123 456", "en"), (5, "mail me at a.b@c.example now please everyone", "en"), (6, "totally different words stay here for good", None)]
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    more = spark.createDataFrame([(7, passage, "en", "s", len(passage))], docs.schema)
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = docs.union(more), {}
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)), "test")
        kept[name] = {r.doc_id for r in at.collect()}
        if name == "personal data":
            assert "[EMAIL]" in at.where("doc_id = 5").first().text and at.columns == docs.columns
    assert kept["language"] == {1, 2, 5, 6, 7}
    assert kept["near copies"] == {1, 5, 6, 7}
    assert kept["benchmark"] == kept["tokens"] == {1, 5, 6}


def test_empty_documents(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)), "test")
    assert at.count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark, docs, tmp_path):
    """Four of 200 words changed: 0.815 by five words, 0.8498 by four; five changed: 0.774, not similar."""
    words = [f"w{i}" for i in range(200)]
    changed = lambda at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))
    rows = [(1, changed(())), (2, changed((30, 70, 110, 150))), (3, changed((20, 60, 100, 140, 180)))]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect()} == {1, 3}
    assert jaccard_join.keep_one(df, "doc_id", "text").count() == 3


@pytest.mark.parametrize("light", [6, 8, 12])
def test_similar_pairs_share_a_list_at_four_fifths(light):
    rng = np.random.default_rng(light)
    for _ in range(300):
        size = int(rng.integers(3, 18))
        base = np.unique(rng.integers(1, 2**62, size + 3).astype(np.uint64))
        a, b = (np.sort(rng.permutation(base)[: int(rng.integers(max(1, size - 1), len(base) + 1))]) for _ in range(2))
        if jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b), 80):
            assert set(jaccard_join.keys(a, light, {}, 80).tolist()) & set(jaccard_join.keys(b, light, {}, 80).tolist())
