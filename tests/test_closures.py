"""Closures send nothing but counts to the driver, whatever the tables of a round hold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import decision as D
from riskloom.operators import quality as Q


def _plans(monkeypatch, module):
    plans, plain = [], module.held
    monkeypatch.setattr(module, "held", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, tag))[1])
    return plans


def test_closure_of_a_chain_without_broadcasts(spark, monkeypatch):
    plans = _plans(monkeypatch, D)
    edges: DataFrame = spark.range(1, 9).select(F.concat(F.lit("v"), "id").alias("variable"), F.concat(F.lit("v"), F.col("id") - 1).alias("needs"))
    got = {(int(r.variable[1:]), int(r.needs[1:])) for r in D.dependency_closure(edges).collect()}
    assert got == {(a, b) for a in range(9) for b in range(a)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_lineage_of_a_chain_without_broadcasts(spark, monkeypatch):
    plans = _plans(monkeypatch, Q)
    edges = spark.range(6).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    assert {(r.node, r.depth) for r in Q.lineage_closure(edges, "n0").collect()} == {(f"n{i}", i) for i in range(1, 7)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
