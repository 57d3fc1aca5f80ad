"""Windows and sinks over several micro-batches, replayed batches and hot keys."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from riskloom.streaming import features as V

FEATURES = "customerId string, window_end timestamp, n long"


def rows(spark, *data):
    return spark.createDataFrame([(k, e, n) for k, e, n in data], "customerId string, e string, n long").select("customerId", F.to_timestamp("e").alias("window_end"), "n")


def feed(spark, path, *batches):
    for lines in batches:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def event(key, at, amount=1.0):
    return f'{{"customerId":"{key}","eventTime":"{at}","amount":{amount}}}'


def test_sliding_windows_close_over_batches_and_late_events_do_not_count(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, [event("C001", f"2026-06-01T10:0{i}:00") for i in range(3)], [event("C001", "2026-06-01T11:30:00", 5), event("C002", "2026-06-01T12:10:00", 2), "{bad"], [event("C003", "2026-06-01T18:00:00")], [event("C001", "2026-06-01T10:30:00")])
    good, _ = V.parse_events(V.event_source(spark, source), "customerId STRING, eventTime TIMESTAMP, amount DOUBLE", ["customerId", "eventTime"])
    with V.large_state(spark):
        query = V.run_available(V.sliding_stream(V.with_event_time(good, "eventTime", "0 seconds"), "customerId", "eventTime", "3 hours", "1 hour", "amount"), out)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    got = {(r.customerId, r.window_end.hour): (r.n, r.total) for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {("C001", 11): (3, 3.0), ("C001", 12): (4, 8.0), ("C001", 13): (4, 8.0), ("C001", 14): (1, 5.0), ("C002", 13): (1, 2.0), ("C002", 14): (1, 2.0), ("C002", 15): (1, 2.0)}


def test_latest_sink_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    V.merge_latest(rows(spark, *((f"k{i}", "2026-06-01 10:00:00", i) for i in range(40))), 0, "customerId", path, buckets=8)
    versions = V._ledger(spark, path)[1]
    assert set(versions.values()) == {0} and len(versions) == 8
    second = rows(spark, ("k1", "2026-06-01 11:00:00", 100), ("k1", "2026-06-01 09:00:00", 5), (None, "2026-06-01 11:00:00", 1))
    V.merge_latest(second, 1, "customerId", path, buckets=8)
    V.merge_latest(second, 1, "customerId", path, buckets=8)  # run again
    assert sorted(V._ledger(spark, path)[1].values()) == [0] * 7 + [1]
    V.merge_latest(rows(spark, ("k1", "2026-06-01 12:00:00", 7), ("new", "2026-06-01 12:00:00", 1)), 2, "customerId", path, buckets=8)
    V.merge_latest(rows(spark, ("k1", "2026-06-01 08:00:00", 9)), 3, "customerId", path, buckets=8)
    got = {r.customerId: r.n for r in V.latest_features(spark, path, second.schema).collect()}
    assert got == {f"k{i}": i for i in range(40)} | {"k1": 7, "new": 1}
    touched = next(b for b, v in V._ledger(spark, path)[1].items() if v == 3)
    assert sorted(x.parent.name for x in Path(path).glob(f"state/*/bucket={touched}")) == ["2", "3"]  # older versions are deleted
    assert V.latest_features(spark, path, second.schema, F.current_timestamp() + F.expr("INTERVAL 25 HOURS")).count() == 0
    assert V.latest_features(spark, str(tmp_path / "none"), second.schema).count() == 0


def test_history_stores_a_key_once_over_batches_and_replays(spark, tmp_path):
    path, keys = str(tmp_path), ["customerId", "window_end"]
    first = rows(spark, ("a", "2026-06-01 10:00:00", 1), ("b", "2026-06-01 10:00:00", 2), ("a", "2026-06-02 10:00:00", 3), ("a", "2026-06-01 10:00:00", 1))
    V.write_history(first, 0, keys, path)
    V.write_history(first, 0, keys, path)
    V.write_history(rows(spark, ("a", "2026-06-01 10:00:00", 1), ("c", "2026-06-02 10:00:00", 4), (None, "2026-06-02 10:00:00", 4)), 1, keys, path)
    V.write_history(rows(spark, ("c", "2026-06-02 10:00:00", 4)), 2, keys, path)
    got = sorted((r.customerId, r.window_end.day, r.n, r.batch) for r in spark.read.parquet(f"{path}/history").collect())
    assert got == [("a", 1, 1, 0), ("a", 2, 3, 0), ("b", 1, 2, 0), ("c", 2, 4, 1)]


def test_look_backs_of_a_hot_key_equal_brute_force(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(0, 40 * 86_400, 600), None if rng.random() < 0.1 else rng.randint(1, 9)) for i in range(900)] + [(900, "alone", 5, None)]
    df = spark.createDataFrame(data, "id long, k string, s long, v long").withColumn("t", F.timestamp_seconds("s")).withColumn("_n", F.lit("clash"))
    out = V.rolling_feature(df.drop("_n"), "k", "t", 7, "v")
    for r in out.collect():
        seen = [v for _, k, s, v in data if k == r.k and r.s - 7 * 86_400 <= s <= r.s]
        known = [v for v in seen if v is not None]
        assert (r.n, r.total) == (len(seen), sum(known) if known else None)
    assert out.count() == 901 and V.rolling_feature(df.drop("_n").where("false"), "k", "t", 7, "v").count() == 0


def test_batch_windows_equal_single_stage_windows(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(0, 30 * 3_600), float(rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    ours = {tuple(r) for r in V.sliding_feature(df, "k", "t", "6 hours", "2 hours", "v").collect()}
    plain = df.groupBy("k", F.window("t", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert ours == {(r.k, r.w.start, r.w.end, r.n, r.s) for r in plain.collect()}
