"""Keys with most of the rows, tables of many rows, deep pages: results against plain Python, and how far a key spreads."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import decision as D
from riskloom.operators import models as M
from riskloom.operators import quality as Q
from riskloom.operators import tables as T


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables would be put together into one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.choice([None, rng.random()])) for i in rng.sample(range(9_000), 3_000)]
    df = spark.createDataFrame(data, "k string, at int, v double")
    return df.withColumns({"range": F.lit("clash"), "own": F.lit(1), "near": F.lit(2), "was": F.lit(3)}).repartition(5)


def test_previous_rows_of_a_hot_key(rows):
    before, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        want[r["at"]] = before.get(r.k)
        before[r.k] = r.v
    out = T.with_previous(rows, ["k"], ["at"], ["v"])
    assert {r["at"]: r.previous_v for r in out.collect()} == want and out.columns == [*rows.columns, "previous_v"]
    assert T.with_previous(rows.where("false"), ["k"], ["at"], ["v"]).count() == 0


def test_a_hot_key_is_in_many_ranges(rows):
    dealt = rows.repartitionByRange("k", "at").withColumn("p", F.spark_partition_id())
    assert dealt.where("k = 'hot'").select("p").distinct().count() > 1


def test_duplicates_and_uniqueness(rows):
    first = {}
    for r in rows.where("k is not null").collect():
        first[r.k] = min(first.get(r.k, 10**9), r["at"])
    want = sorted(r["at"] for r in rows.where("k is not null").collect() if r["at"] != first[r.k])
    assert sorted(r["at"] for r in T.duplicates(rows, "k", ["at"]).collect()) == want
    rule = {"ruleId": "u", "dimension": "UNIQUENESS", "column": "k", "expression": "UNIQUE", "severity": "LOW"}
    assert sorted(r["at"] for r in Q.check_quality(rows, [rule], "at").collect()) == want
    same = rows.select(F.lit("x").alias("k"), F.lit(1).alias("at")).limit(10)
    assert T.duplicates(same, "k", ["at"]).count() == 9


def test_drop_against_the_first_value(rows):
    first = {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        first.setdefault(r.k, r.v)
    for r in M.ks_trend(rows, "k", "at", "v").collect():
        want = None if first[r.k] is None or r.v is None else (first[r.k] - r.v) / first[r.k]
        assert r.drop == (want if want is None else pytest.approx(want))


def test_splits_of_one_time(spark):
    df = spark.createDataFrame([(i, "2024-01-01 00:00:00" if i < 900 else "2023-01-01 00:00:00") for i in range(1000)], "id int, t string").withColumn("t", F.to_timestamp("t"))
    out = M.split_time(df, "t", {"a": 0.1, "b": 0.6, "c": 0.3})
    assert dict(out.groupBy("split").count().collect()) == {"a": 100, "b": 600, "c": 300}
    assert {r.id for r in out.where("split = 'a'").collect()} == set(range(900, 1000)) and out.select("id").distinct().count() == 1000


@pytest.mark.parametrize("number", [1, 7, 60, 200, 201])
def test_deep_pages_equal_shallow_ones(rows, number):
    order = [F.desc_nulls_last("v"), F.col("at")]
    deep, total = T.page(rows, order, number, 15, shallow=100)
    plain = rows.orderBy(*order).offset((number - 1) * 15).limit(15)
    assert [tuple(r) for r in deep.collect()] == [tuple(r) for r in plain.collect()] and total == 3_000


def test_large_decision_tables_equal_the_chain(spark):
    rng = random.Random(5)
    cell = lambda n: rng.choice(["*", "*", None, *map(str, range(n))])
    table = {"columns": [{"field": "a"}, {"field": "b"}, {"field": "c"}], "rows": [{"conditions": [cell(9), cell(5), cell(3)], "result": {"limit": i, "word": rng.choice([None, "x", "y"])}} for i in range(400)]}
    data = [(rng.choice([None, *range(12)]), rng.choice([None, *map(str, range(6))]), str(rng.randrange(4)), {"m": i}) for i in range(500)]
    df = spark.createDataFrame(data, "a int, b string, c string, _dt map<string,int>")
    got = [(r.row, r.limit, r.word) for r in D.apply_decision_table(df, table).collect()]
    for r, (row, limit, word) in zip(data, got):
        cells = [None if v is None else str(v) for v in r[:3]]
        want = next((i for i, x in enumerate(table["rows"]) if all(y == "*" or y == v for y, v in zip(x["conditions"], cells))), None)
        assert row == want and (want is None or (limit, word) == (want, table["rows"][want]["result"]["word"]))
    plan = D.apply_decision_table(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Aggregate" not in plan
