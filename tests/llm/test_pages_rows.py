"""Neighbours of pages against brute force: hosts, copies, ties and any number of ranges; planned shards in order of id."""

import random
import tracemalloc
from collections import Counter
from hashlib import md5
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pages, sharding


def brute(rows):
    """id to text: all pages are looked through for each page."""
    lined = {(i, url): pages.lines_of(html) for i, url, html in rows}
    keys = {}
    for i, url in lined:
        host, _, path = url.removeprefix("http://").partition("/")
        keys[i, url] = (host, "/" + path, md5(repr(lined[i, url]).encode()).digest())
    versions = {k: lined[x] for x, k in keys.items()}
    out = {}
    for x, key in keys.items():
        if any(state == pages.CONTENT for _, state in lined[x]):
            out[x] = "\n\n".join(line for line, state in lined[x] if state == pages.CONTENT)
            continue
        others = [k for k in versions if k[0] == key[0] and k[2] != key[2]]
        near = [max((k for k in others if k < key), default=None), min((k for k in others if k > key), default=None)]
        best = max(near, key=lambda k: -1 if k is None else next((i for i, (a, b) in enumerate(zip(k[1] + "\0", key[1] + "\1")) if a != b)))
        out[x] = pages.differenced(lined[x], versions[best] if best else None)
    return out


@pytest.mark.parametrize("ranges", ["1", "3", "16"])
def test_neighbours_do_not_depend_on_ranges(spark, ranges):
    rng = random.Random(5)
    page = lambda own: f"<body><p>Home | About</p><p>{own}</p><p>Foot {rng.randint(0, 1)}</p></body>"
    rows = [(i, f"http://{rng.choice('gh')}.example/{rng.choice('ab')}/{rng.randint(0, 12)}", page(f"Story {rng.randint(0, 8)}")) for i in range(60)]
    rows += [(i, f"http://k.example/c/{i}", "<p>same</p><p>copy</p>") for i in range(100, 130)] + [(200, "http://k.example/d", "<p>same</p><p>other</p>"), (201, "http://l.example/", "<p>alone")]
    rows += [(300, "http://g.example/a/3", "<article><p>Told</article>"), (301, "http://g.example/a/4", "")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "digest": F.lit(2), "text": F.lit("x")})
        got = {(r.page_id, r.url): r.text for r in pages.extract(df, "page_id", "url", "html").collect()}
        assert pages.extract(df.where("false"), "page_id", "url", "html").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert all(got[i, f"http://k.example/c/{i}"] == "copy" for i in range(100, 130))


def test_equal_lines_in_thousands_are_common():
    assert len(pages.common(["x"] * 20_000, ["x"] * 20_000)) == 20_000


def test_common_lines_equal_the_table_of_lengths():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        got = [a[i] for i in sorted(pages.common(a, b))]
        at = iter(b)
        assert len(got) == best[-1][-1] and all(x in at for x in got)


def test_many_equal_lines_take_little_memory():
    rng = random.Random(1)
    a, b = (["ab"[rng.random() < 0.5] for _ in range(4_000)] for _ in range(2))
    tracemalloc.start()
    got = pages.common(a, b)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000 and 3_000 < len(got) < 4_000
    tracemalloc.stop()


def test_plan_fills_files_in_order_of_id(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", rng.randint(0, 1), rng.randint(1, 9), 10 * i, 10 * i + 5, rng.randint(10, 90)) for i in range(200)] + [("lone", 2, 1, 0, 1, 10), ("large", 0, 1, 0, 1, 300)]
    got = {r.shard: r.bin for r in sharding.plan(spark.createDataFrame(rows, "shard string, tier int, shard_rows long, low long, high long, shard_bytes long").repartition(7), 300).collect()}
    want = {}
    for tier in (0, 1):
        own = sorted((low, high, n, shard, size) for shard, t, n, low, high, size in rows if t == tier and size < 300)
        want |= {x[3]: tier * 1_000_000_000 + (end - x[4]) // 300 for x, end in zip(own, accumulate(x[4] for x in own))}
    many = Counter(want.values())
    assert got == {k: b for k, b in want.items() if many[b] > 1}
