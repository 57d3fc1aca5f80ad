"""Compaction writes a row again only while its file is small."""

import random

from riskloom.llm import sharding


def test_merged_files_near_the_target_are_not_merged_again(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path)
    rows = [(i, "".join(chr(rng.randrange(32, 127)) for _ in range(6_000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = sharding.shard(df, "doc_id", root, arrival_rows=1, target_bytes=60_000)
    assert {(r.doc_id, r.text) for r in held.collect()} == set(rows)
    assert sharding.versions(spark, root) == [1, 2]
    sizes = sorted(r.shard_bytes for r in sharding.manifest_of(spark, root).collect())
    assert len(sizes) >= 8 and sizes[1] >= 30_000 and sizes[-1] < 60_000
