"""Metrics on literal cases, plans without a task for all rows, streams against their batch form."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators import quality as Q
from riskloom.operators import tables as T
from riskloom.streaming import features as V


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert tuple(M.ks(df, "y", "p").first()) == (0.0, 0.5)


def test_auc_and_ks_against_pairs(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(400)]
    df = spark.createDataFrame(data, "y int, p double")
    ones, zeros = [p for y, p in data if y], [p for y, p in data if not y]
    pairs = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert M.auc(df, "y", "p").first()["auc"] == pytest.approx(pairs)
    gap = max(abs(sum(x <= t for x in ones) / len(ones) - sum(x <= t for x in zeros) / len(zeros)) for t in {p for _, p in data})
    assert M.ks(df, "y", "p").first()["ks"] == pytest.approx(gap)


def test_constant_column_has_no_information(spark):
    df = spark.createDataFrame([(i % 2, 1.0) for i in range(50)], "y int, c double")
    assert M.feature_iv(df, ["c"], "y").first()["iv"] == pytest.approx(0.0)


def test_splits_are_exact_and_disjoint(spark):
    out = M.split_random(spark.range(1000).withColumn("s", F.lit("x")), "id", {"a": 0.7, "b": 0.3}, 1)
    assert dict(out.groupBy("split").count().collect()) == {"a": 700, "b": 300}
    assert out.select("id").distinct().count() == 1000


def test_correlated_feature_goes(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(x := rng.random(), x * 2, rng.random()) for _ in range(100)], "a double, b double, c double")
    assert M.correlation_filter(df, ["a", "b", "c"], {"a": 0.2, "b": 0.5, "c": 0.1}) == ["b", "c"]


def test_top_percent_breaks_ties_by_the_tie_column(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id int, s double")
    assert sorted(r.id for r in T.top_percent(df, "s", 15, "id").collect()) == [0, 1, 2]


def test_enum_keeps_case_and_null_passes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "id int, w string")
    rule = {"ruleId": "r", "dimension": "ACCURACY", "column": "w", "expression": "ENUM:A, B", "severity": "LOW"}
    assert [r.id for r in Q.check_quality(df, [rule], "id").collect()] == [1]


def test_lineage_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {r.node for r in Q.lineage_closure(edges, "a").collect()} == {"b", "c"}


def test_sliding_windows_in_two_stages_equal_one(spark):
    df = spark.createDataFrame([(1, f"2024-01-01 0{i}:30:00", float(i)) for i in range(8)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    ours = {tuple(r) for r in V.sliding_feature(df, "k", "t", "3 hours", "1 hour", "v").collect()}
    plain = df.groupBy("k", F.window("t", "3 hours", "1 hour")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert ours == {(r.k, r.window.start, r.window.end, r.n, r.s) for r in plain.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    lines = [f'{{"k":"a","t":"2024-01-01T0{h}:10:00"}}' for h in (1, 5, 6, 7)]  # a late row is judged by the watermark before the last
    source = str(tmp_path / "in")
    for i, line in enumerate([*lines, '{"k":"a","t":"2024-01-01T01:20:00"}', '{"k":"a","t":"2024-01-01T09:10:00"}', "{bad"]):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(source)
    good, bad = V.parse_events(V.event_source(spark, source), "k STRING, t TIMESTAMP", ["k", "t"])
    made = V.with_event_time(good, "t", "0 seconds").groupBy(F.window("t", "1 hour"), "k").count().select(F.col("window.start").alias("s"), "count")
    V.run_available(made, str(tmp_path / "out"))
    counts = {r.s.hour: r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()}
    assert counts[1] == 1 and counts[5] == 1


def test_stream_quality_names_every_violation(spark):
    df = spark.createDataFrame([("{bad",), ('{"op_type":"X","customerId":"","amount":-1}',)], "value string")
    found = sorted((r.rule, r.field) for r in V.stream_quality(df).collect())
    assert found == [("ACCURACY", "amount"), ("COMPLETENESS", "customerId"), ("COMPLETENESS", "eventTime"), ("SCHEMA", "op_type"), ("SCHEMA", "payload")]
