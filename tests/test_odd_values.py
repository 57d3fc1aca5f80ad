"""Scores of 0, above 1, below 0 and absent ones: queries against their SQL, operators against IEEE arithmetic."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.plans.registry import load
from test_oracle import plain

VALUES = [0.0, 12.5, 0.0, None, 560.21, 500.0, -3.0, 0.004, 25.0, 499.99]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with events of odd values; each user's first value is the one of that number."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, i % len(VALUES), "error" if i % 3 else "view", VALUES[(i + i // len(VALUES)) % len(VALUES)], '{"k": 7}') for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["w05_ks_trend", "m19_score_distribution", "u03_artefact_diff"])
def test_odd_values_agree_with_sql(spark, odd, name):
    query, sql = load()[name]
    df = query(spark, odd)
    columns = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet/*.parquet'")
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    theirs = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == theirs


def test_drop_against_a_first_value_of_zero(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 0.5), ("a", 4, -0.5), ("a", 5, None), ("b", 1, 0.4), ("b", 2, 0.3)], "k string, at int, v double")
    got = {(r.k, r["at"]): r["drop"] for r in M.ks_trend(rows, "k", "at", "v").collect()}
    assert math.isnan(got["a", 1]) and math.isnan(got["a", 2]) and got["a", 3] == -math.inf and got["a", 4] == math.inf and got["a", 5] is None
    assert got["b", 1] == 0 and got["b", 2] == pytest.approx(0.25)
