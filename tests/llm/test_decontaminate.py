"""Rows with repeated or null ids, and items without an id, in one pass and in several; all windows by plain comparison."""

import random

import pytest

from riskloom.llm import decontaminate


@pytest.mark.parametrize("pass_bytes", [10**6, 20])
def test_every_row_and_item_counts(spark, pass_bytes):
    docs = spark.createDataFrame([(1, "alpha beta x"), (1, "y z"), (None, "gamma delta"), (None, "q alpha beta"), (2, "plain")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "alpha beta"), ("b", "not here at all"), (None, "gamma"), (None, "delta"), (None, "z")], "item_id string, text string")
    found = decontaminate.find_items(docs, "doc_id", "text", bench, "item_id", "text", pass_bytes=pass_bytes)
    got = sorted((r.doc_id or 0, r.n_words, r.hits, [x or "" for x in r.items]) for r in found.collect())
    assert got == [(0, 2, [0, 1], [""]), (0, 3, [1, 2], ["a"]), (1, 2, [1], [""]), (1, 3, [0, 1], ["a"]), (2, 1, [], [])]
    assert sorted((r.n_hit, r.n_items) for r in decontaminate.digest(found, "doc_id").collect()) == [(0, 0), (1, 1), (2, 1), (2, 1), (2, 1)]


def _plain(text: str | None, items: list[tuple[str, str]], window: int) -> tuple[list[int], list[str]]:
    """Every window of every item is looked for at every place."""
    words, hit, names = decontaminate.words_of(text), set(), set()
    for item, own in ((i, decontaminate.words_of(t)) for i, t in items):
        m = min(window, len(own))
        for pattern in {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else ():
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) == pattern:
                    hit.update(range(k, k + m))
                    names.add(item)
    return sorted(hit), sorted(names)


@pytest.mark.parametrize("pass_bytes", [10**6, 400])
def test_hits_are_those_of_plain_comparison(spark, pass_bytes):
    """Texts of few words, so that windows overlap, repeat and lie in several passes; one long text; null and empty ones."""
    rng = random.Random(6)

    def text(n: int) -> str:
        return " ".join(rng.choice(["Ab", "b", "c", "é", "7"]) for _ in range(n))

    items = [(f"i{k}", text(rng.choice([1, 2, 4, 9, 25]) + 3)) for k in range(40)] + [("none", " - "), ("twin", "Ab b c 7 Ab")]
    texts = [text(rng.randrange(40)) for _ in range(60)] + [None, "", "x " * 3_000 + items[3][1] + " y" * 3_000]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find_items(docs, "doc_id", "text", bench, "item_id", "text", window=5, pass_bytes=pass_bytes).collect()
    want = {i: (len(decontaminate.words_of(t)), *_plain(t, items, 5)) for i, t in enumerate(texts)}
    assert len(found) == len(texts) and {r.doc_id: (r.n_words, r.hits, r.items) for r in found} == want
    assert any(x[1] for x in want.values()) and not all(x[1] for x in want.values())


@pytest.mark.parametrize("pass_bytes", [10**6, 1])
def test_empty_tables(spark, pass_bytes):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a b")], "item_id string, text string")
    told = [decontaminate.find_items(d, "doc_id", "text", b, "item_id", "text", pass_bytes=pass_bytes).collect() for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)))]
    assert told[0] == [] and [tuple(r) for r in told[1]] == [(1, 2, [], [])]
