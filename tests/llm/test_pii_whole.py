"""The trees and thresholds of personal data learn from every document and every candidate."""

from pyspark.sql import functions as F

from riskloom.llm import pii


def test_every_candidate_is_learned_from(spark, monkeypatch):
    kind, met = pii.GBTClassifier, {}

    class Counted(kind):
        def fit(self, data, params=None):
            met["learned"] = data.count()
            model = kind.fit(self, data, params)
            plain = model.transform
            model.transform = lambda held: (met.update(graded=held.count()), plain(held))[1]
            return model

    monkeypatch.setattr(pii, "GBTClassifier", Counted)
    text = F.concat(F.lit("a"), "id", F.when(F.col("id") % 2 == 0, F.lit("@b.example token = x1y2z3x1y2z3x1y2z3")).otherwise(F.lit(" 9999999999999999 anticonstitutionnellement2")))
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert pii.find(docs, "doc_id", "text").where("doc_id < 4").count() == 4
    loose = pii.candidates(docs, "text").select(((F.crc32(F.col("doc_id").cast("string")) % 5) == 0).alias("held"), (F.size("_base") + F.size("_loose")).alias("n"))
    want = {r.held: r.n for r in loose.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    assert want[False] > 30_000 and (met["learned"], met["graded"]) == (want[False], want[True])
