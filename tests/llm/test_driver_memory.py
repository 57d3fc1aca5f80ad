"""What the stages of the pipeline leave on the driver, and what they run on the executors besides their work."""

import uuid

import corpus_pipeline
from pyspark.sql.classic.dataframe import DataFrame
from riskloom.llm import bpe, common
from riskloom.llm.queries import RANKS


def test_personal_data_runs_no_python(spark, tmp_path, monkeypatch):
    """Also what the stage frees on a cluster is a job of DataFrame operations."""
    monkeypatch.setattr(common, "_local", lambda spark: False)
    monkeypatch.setattr(common, "scratch", lambda spark, tag: f"{tmp_path}/{tag}-{uuid.uuid4().hex}")
    monkeypatch.setattr(DataFrame, "mapInArrow", None)
    docs = spark.createDataFrame([(1, "write to a@b.cd", "en", "web", 15), (2, None, "en", "web", 0)], "doc_id bigint, text string, lang string, source string, n_chars int")
    assert [tuple(r) for r in corpus_pipeline.personal_data(spark, docs, "").orderBy("doc_id").collect()] == [(1, "write to [EMAIL]", "en", "web", 16), (2, None, "en", "web", None)]


def test_plans_do_not_print_the_ranks(spark):
    """The driver keeps descriptions of the plans that have run; one with all ranks takes megabytes."""
    folded = bpe.fold_words(spark.createDataFrame([("walking",), ("ärger",)], "w string"), "w", RANKS)
    assert len(folded._jdf.queryExecution().toString()) < 100_000
    table = bpe.ranks(RANKS)
    pieces = {i: piece for piece, i in table.items()}
    assert {r.w: b"".join(pieces[i] for i in r.ids).decode() for r in folded.collect()} == {"walking": "walking", "ärger": "ärger"}
