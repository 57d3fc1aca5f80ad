"""Shards: clashing columns, many arrivals, repeated compaction, two writers, and the plan against a plain one."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import sharding


def table(spark, low, high, size=200):
    rows = [(i, f"{i % 7} " * (i % size)) for i in range(low, high)] + [(None, "no id"), (None, None), (low, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def count(df, columns=("doc_id", "text")):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", ["shard", "bin", "tier", "version", "row"])
def test_clashing_columns_keep_their_rows(spark, tmp_path, name):
    df = table(spark, 0, 60).withColumn(name, F.lit("mine"))
    held = sharding.shard(df, "doc_id", str(tmp_path), arrival_rows=5, target_bytes=4_000)
    assert held.columns == [*df.columns, "stored"] and count(held, df.columns) == count(df, df.columns)


def test_clashing_facts_are_refused_under_that_name(spark, tmp_path):
    df = table(spark, 0, 9).withColumn("Stored", F.lit(1))
    with pytest.raises(ValueError):
        sharding.shard(df, "doc_id", str(tmp_path))
    assert count(sharding.shard(df, "doc_id", str(tmp_path / "b"), facts="file")) == count(df)


def test_arrivals_compaction_and_expiry(spark, tmp_path):
    root, all_rows = str(tmp_path), Counter()
    for k in range(3):
        df = table(spark, 100 * k, 100 * k + 80)
        all_rows += count(df)
        sharding.append(df, "doc_id", root, arrival_rows=6)
        sharding.compact(spark, root, "doc_id", df.schema, 5_000)
    last = sharding.settle(spark, root, "doc_id", df.schema, 5_000)
    assert sharding.versions(spark, root)[-1] == last and sharding.compact(spark, root, "doc_id", df.schema, 5_000) is None
    for version in sharding.versions(spark, root):
        held = sharding.rows_of(spark, root, version, df.schema)
        manifest = {r.shard: r for r in sharding.manifest_of(spark, root, version).collect()}
        met = Counter(r.stored.shard for r in held.collect())
        assert met == {s: r.shard_rows for s, r in manifest.items()}
        assert all(r.tier == tier(r.shard_bytes) for r in manifest.values())
    assert count(sharding.rows_of(spark, root, last, df.schema)) == all_rows
    files = lambda: {str(p.relative_to(tmp_path / "data")) for p in (tmp_path / "data").rglob("*.parquet")}
    stray = table(spark, 0, 3)
    stray.write.parquet(f"{root}/data/died")
    assert sharding.expire(spark, root) > 0 and files() == set(manifest) and sharding.versions(spark, root) == [last]
    assert count(sharding.rows_of(spark, root, last, df.schema)) == all_rows


def tier(size):
    k = 0
    while size >= sharding.BASE_BYTES * sharding.FANOUT ** (k + 1):
        k += 1
    return k


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path), table(spark, 0, 40)
    sharding.append(df, "doc_id", root, arrival_rows=5)
    plain, calls = sharding.plan, []

    def slow(*args):
        if not calls:
            calls.append(sharding.append(table(spark, 500, 510), "doc_id", root))
        return plain(*args)

    monkeypatch.setattr(sharding, "plan", slow)
    with pytest.raises(FileExistsError):
        sharding.compact(spark, root, "doc_id", df.schema, 5_000)
    assert count(sharding.rows_of(spark, root, 2, df.schema)) == count(df) + count(table(spark, 500, 510))
    seen = sharding.versions

    monkeypatch.setattr(sharding, "versions", lambda s, r: (monkeypatch.setattr(sharding, "versions", seen), [1])[1])
    assert sharding.append(df, "doc_id", root) == 3  # its first try meets version 2
    assert not list((tmp_path / "manifest").glob("_*"))


def test_plan_equals_a_plain_one(spark):
    sizes = [(i * 7919 % 1000, (i * 131) % 900 + 50) for i in range(300)] + [(5, 30_000_000), (6, 3_000_000)]
    rows = [(f"s{i:03d}", b * 1_000, 10, low, low + 5, tier(b * 1_000)) for i, (low, b) in enumerate(sizes)]
    manifest = spark.createDataFrame(rows, "shard string, shard_bytes long, shard_rows long, low long, high long, tier int")
    target, want = 2_000_000, {}
    for k in {r[5] for r in rows}:
        own = sorted((r for r in rows if r[5] == k and r[1] < target), key=lambda r: (r[3], r[4], r[2], r[0]))
        run = 0
        for r in own if len(own) >= sharding.FANOUT else []:
            want[r[0]] = (k, run // target)
            run += r[1]
    alone = {b for b, n in Counter(want.values()).items() if n == 1}
    got = {r.shard: divmod(r.bin, 1_000_000_000) for r in sharding.plan(manifest, target).collect()}
    assert got == {s: b for s, b in want.items() if b not in alone} and len(got) > 200


def test_empty_table_and_long_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, ""), (2, "")], "doc_id long, text string")
    assert count(sharding.shard(df, "doc_id", str(tmp_path / "a"))) == count(df)
    none = sharding.shard(df.where("false"), "doc_id", str(tmp_path / "b"))
    assert none.columns == ["doc_id", "text", "stored"] and none.count() == 0
