"""The learned part of personal data: spans beyond the base, clashing columns, thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pii


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        return next(body + d for d in "0123456789" if sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(body + d))) % 10 == 0)

    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(1200):
        parts = ["some words here", rng.choice([f"+1 ({number(3)}) 555-{number(4)}", f"a{i}@b.example", f"10.{i % 256}.3.{i % 99}", card(), number(16), f'token = "{hexes(40)}"', f"anticonstitutionnellement2 word{i}"]), "and more"]
        rows.append((i, " ".join(parts)))
    rows += [(5000, "ring (212) 555-0199 now"), (5001, f'see "{hexes(40)}" there'), (5002, "nothing of the kind 12 34"), (5003, "9" * 16 + " x"), (5004, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spans_beyond_the_base(docs):
    out = {r.doc_id: r for r in pii.digest(pii.find(docs, "doc_id", "text"), "doc_id").collect()}
    assert out[5000].spans == "phone:5:19" and out[5000].n_phone == 0
    assert out[5001].spans == "secret:5:45"
    assert out[5002].spans == "" and out[5003].spans == "" and out[5004].spans == ""
    plain = [k for k, r in {r.doc_id: r.text for r in docs.collect()}.items() if r and "anticonstitutionnellement2" in r]
    assert all(out[k].spans == "" for k in plain)
    tokens = {r.doc_id for r in docs.where(F.col("text").contains("token")).collect()}
    assert sum(out[k].spans.startswith("secret") for k in tokens) == len(tokens)


def test_extra_columns_with_the_names_inside(docs):
    names = ["_all", "_loose", "_text", "_base", "_every", "_spans", "spans", "id", "c"]
    wide = docs.where("doc_id >= 5000 or doc_id < 60").withColumns({n: F.lit(7) for n in names})
    hidden = pii.redact(wide, "doc_id", "text")
    assert hidden.columns == wide.columns and hidden.where(" or ".join(f"`{n}` <> 7" for n in names)).count() == 0
    assert hidden.where("doc_id = 5004 and text is null").count() == 1
    assert pii.redact(wide.where("false"), "doc_id", "text").count() == 0


def test_threshold_of_labelled_and_unlabelled_bins():
    assert pii.threshold([]) == 1.01
    assert pii.threshold([(90, 9, 10), (10, 1, 100)]) == pytest.approx(0.89)
    assert pii.threshold([(50, 10, 20)]) == pytest.approx(0.49)  # half of the positives have a label
    assert pii.threshold([(5, 0, 30)]) == 1.01


def test_many_spans_cost_little_more_than_their_number(spark):
    """300,000 characters with 50,000 spans: arrays that grow by appending would take minutes."""
    df = spark.createDataFrame([(1, "a@b.c " * 50_000), (2, "10.0.0.1 x@y.zz " * 300), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.candidates(df, "text").select("doc_id", "_loose", F.expr("transform(_base, c -> struct(c.kind, c.start, c.end))").alias("b")).collect()}
    assert [tuple(x) for x in out[1].b] == [(1, 6 * i, 6 * i + 5) for i in range(50_000)] and out[1]["_loose"] == []
    assert sorted(tuple(x) for x in out[2].b) == sorted([(2, 16 * i, 16 * i + 8) for i in range(300)] + [(1, 16 * i + 9, 16 * i + 15) for i in range(300)])


def test_flags_of_neighbours_equal_all_comparisons(spark):
    rng = random.Random(8)

    def spans(n, kinds):
        made = {(rng.choice(kinds), s := rng.randrange(300), s + rng.randint(1, 12)) for _ in range(n)}
        return [(k, s, e, "v", "", "", False) for k, s, e in made]

    rows = [(i, spans(rng.randint(0, 12), [1, 2, 3]), spans(rng.randint(0, 25), [1, 2, 5])) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, base array<{pii.SPAN}>, loose array<{pii.SPAN}>")
    got = {r.id: [((y.c.kind, y.c.start, y.c.end), y.same, y.met) for y in r.f] for r in df.select("id", F.expr(pii.flagged("base", "loose")).alias("f")).collect()}
    for i, base, loose in rows:
        want = [(c[:3], any(b[1:3] == c[1:3] for b in base), any(b[1] < c[2] and c[1] < b[2] for b in base)) for c in loose]
        assert sorted(got[i]) == sorted(want)


def test_redaction_over_blocks_equals_cutting_the_text(spark, docs):
    rng = random.Random(2)
    texts = [("ü😀x " * rng.randint(0, 900)) + rng.choice(["a@b.cc", "10.0.0.1", "+1 (555) 555-1234", "x"]) + " " * rng.randint(0, 5) + "é" * rng.choice([0, 999, 1000, 1001, 2000]) + " q@r.ss" for _ in range(40)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = {r.doc_id: (r.text, r.spans) for r in pii.find(df, "doc_id", "text").where("doc_id >= 5000").collect()}
    hidden = {r.doc_id: r.text for r in pii.redact(df, "doc_id", "text").where("doc_id >= 5000").collect()}
    for key, (text, spans) in found.items():
        at, out = 0, ""
        for c in sorted(spans, key=lambda c: (c.start, -c.end)):
            if c.start >= at:
                out += text[at : c.start] + f"[{pii.KINDS[c.kind - 1].upper()}]"
            at = max(at, c.end)
        assert hidden[key] == (None if text is None else out + text[at:])
    assert sum("[" in (t or "") for t in hidden.values()) >= 40
