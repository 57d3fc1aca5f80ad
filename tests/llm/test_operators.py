"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, jaccard_join, langid, media, pages, pii, suffix_tree, toxicity
from riskloom.llm.graph import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the rend and of threlyes thor onst ouble edoution with éa über niño 42 x1 it's".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    base = text(rng, 60)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (6, base + " tail"), (7, "one"), (8, "one"), (9, "a b"), (10, "z" * 3000), (11, text(rng, 4000)), (12, "=" * 700 + "  x y\x1cz")]
    rows += [(i, text(rng, rng.randint(1, 40))) for i in range(20, 50)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("tokens", F.lit(0))


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def empty(docs):
    return docs.where("false")


def test_bpe_equals_tiktoken_and_round_trips(docs):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    out = {r.doc_id: r for r in bpe.digest(bpe.encode(docs, "doc_id", "text", RANKS, "decoded"), "doc_id").collect()}
    for key, value in texts(docs).items():
        ids = encoder.encode_ordinary(value or "")
        assert out[key].n_tokens == len(ids)
        assert out[key].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[key].decoded_sha256 == hashlib.sha256((value or "").encode()).hexdigest()
    assert bpe.encode(empty(docs), "doc_id", "text", RANKS).count() == 0


def test_fold_of_higher_order_functions_equals_batch_fold(spark):
    words = ["the", " threlyes", "naïve", "日本", "😀x", "a", "=====", "zzzz"]
    folded = {r.w: r.ids for r in bpe.fold_words(spark.createDataFrame([(w,) for w in words], "w string"), "w", RANKS).collect()}
    known = bpe.Words(RANKS, {})
    assert all(folded[w] == known.folded([w.encode()])[0].tolist() == known.long(w.encode()) or known.table.get(w.encode()) is not None for w in words)


def test_decode_of_ids(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None), (4, [10**6])], "id int, ids array<int>")
    got = {r.id: r.decoded for r in bpe.decode(df, "ids", RANKS).collect()}
    table = {v: k for k, v in bpe.ranks(RANKS).items()}
    assert got[1] == table[0] + table[1] and got[2] == b"" and got[3] is None and got[4] == b""


def test_language(spark):
    rng = random.Random(1)
    own = {"aa": "lumba rota senti kova".split(), "bb": "schrift geht durch hoch".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "12 34 !", "aa"), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    out = {r.doc_id: r for r in langid.predict(df, "text", model, ["doc_id"]).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:80])
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (100, 101, 102))
    assert langid.predict(df, "text", langid.fit(df.where("false"), "doc_id", "text", "lang"), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_pages(spark):
    article = "<h1>Title &amp; more</h1><p><b>First  line<br><p>Second</p>"
    html = f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><article>{article}<div class="comments"><p>rude</p></div></article><footer>&copy; x</footer></body></html>'
    plain = "<body><p>Home | About</p><p>Story {0}</p><p>Footer words</p></body>".format
    rows = [(1, "http://h.example/a/1", html), (2, "http://h.example/a/2", None), (3, "http://g.example/b/1", plain(1)), (4, "http://g.example/b/2?x=1", plain(2)), (5, None, "<p>alone"), (6, "http://h.example/a/1", html)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "url", "html").collect()}
    assert out[1] == out[6] == "Title & more\n\nFirst line\n\nSecond"
    assert out[2] == "" and out[5] == "alone"
    assert out[3] == "Story 1" and out[4] == "Story 2"


def test_common_lines_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
        best = max(k for k in range(len(a) + 1) for c in itertools.combinations(range(len(a)), k) if any([a[i] for i in c] == [b[j] for j in e] for e in itertools.combinations(range(len(b)), k)))
        assert len(pages.common(a, b)) == best


def test_media(docs):
    out = {r.doc_id: r for r in media.media_features(media.text_images(docs, "doc_id", "text"), "doc_id").collect()}
    for key, value in texts(docs).items():
        raw = (value or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (out[key].n_bytes, out[key].payload_bytes) == (len(raw), len(payload))
        assert out[key].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[key].tail_crc32 == zlib.crc32(payload[-64:])
    assert out[4].feature == out[5].feature and out[4].media_sha256 == out[5].media_sha256


def test_every_row_filter_and_broken_images():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (10, 64), np.uint8)
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]
    lines = np.zeros((10, 65), np.uint8)
    for i, kind in enumerate(kinds):
        up = samples[i - 1].astype(int) if i else np.zeros(64, int)
        left, corner = np.concatenate([[0], samples[i][:-1]]).astype(int), np.concatenate([[0], up[:-1]])
        near = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]).argmin(0)
        guess = [np.zeros(64, int), left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        lines[i] = np.concatenate([[kind], (samples[i].astype(int) - guess) & 255])
    assert (media.unfilter(lines) == samples).all()
    image = bytearray(media.write_png(samples.tobytes()))
    assert (media.read_png(bytes(image)) == samples).all()
    image[60] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(image))


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [rng.choice(WORDS) + str(i % 97) for _ in range(20)] + [rng.choice(["gruzzo", "fnorba", "skelti"]) for _ in range(rng.randint(2, 4))] * toxic
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic")
    out = {r.doc_id: r for r in toxicity.predict(df, "doc_id", "text", model).collect()}
    assert all(out[i].toxic == bool(t) for i, t in labels) and not out[900].toxic and not out[901].toxic
    assert all(0 <= r.severity <= 2 for r in out.values())
    none = toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert toxicity.predict(df, "doc_id", "text", none).where("toxic").count() == 0


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(9)
    item = text(rng, 30)
    bench = [("i1", item), ("i2", "short one"), ("i3", None), ("i4", ""), ("i5", item.upper()), ("i6", "the")]
    extra = spark.createDataFrame([(200, "x " + item + " y"), (201, "Short; ONE"), (202, " ".join(item.split()[3:17])), (203, text(rng, 9) + " short")], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(extra)
    found = decontaminate.find_items(all_docs, "doc_id", "text", spark.createDataFrame(bench, "item_id string, text string"), "item_id", "text")
    split = decontaminate.find_items(all_docs, "doc_id", "text", spark.createDataFrame(bench, "item_id string, text string"), "item_id", "text", pass_bytes=100)
    windows = {k: [tuple(w[i : i + min(13, len(w))]) for i in range(len(w) - min(13, len(w)) + 1)] if (w := decontaminate.words_of(t)) else [] for k, t in bench}
    rows, parts = ({r.doc_id: r for r in x.collect()} for x in (found, split))
    for key, value in texts(all_docs).items():
        words, hit, names = decontaminate.words_of(value), set(), set()
        for name, own in windows.items():
            for w in own:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        names.add(name)
        for got in (rows[key], parts[key]):
            assert (got.n_words, got.hits, got.items) == (len(words), sorted(hit), sorted(names))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(value):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], value) if fits(k, m[0])]


def test_personal_data_keeps_all_base_spans(spark):
    rng = random.Random(5)
    cases = [None, "", "é a.b@c.d.e@f.gh", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 010.0.0.255", "4111 1111-1111 1111", "4111111111111112", "+1 (212) 555-0199.", "+1", "9" * 5000, "a" * 5000 + "@b.c", "5-5-5 5"]
    cases += ["".join(rng.choice("01 -.+@ab()é45") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.digest(pii.find(df, "doc_id", "text"), "doc_id").collect()}
    for key, value in enumerate(cases):
        base = base_spans(value or "")
        assert out[key].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), value
        assert set(base) <= set(out[key].spans.split(",")) | {""}
    hidden = {r.doc_id: r.text for r in pii.redact(df, "doc_id", "text").collect()}
    assert hidden[0] is None and hidden[8] == "[PHONE]." and hidden[6] == "[CARD]"


def test_suffix_tree_base_is_exact_and_model_is_a_distribution(docs):
    model = suffix_tree.fit(docs.where("doc_id % 5 <> 1"), "text")
    out = {r.doc_id: r for r in suffix_tree.score(docs, "doc_id", "text", model).collect()}
    words = {k: suffix_tree.words_of(v) for k, v in texts(docs).items()}
    counts = Counter(w for k, own in words.items() if k % 5 != 1 for w in own)
    total, distinct = sum(counts.values()), len(counts)
    for key, own in words.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        got = out[key]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert got.base_score == pytest.approx(base)
    tree = model[0]
    for level in range(1, len(tree.levels) + 1):
        for context in tree.levels[level - 1][0][:5]:
            states = np.full(len(tree.known), context)
            assert (10 ** tree.below(level, states, np.arange(len(tree.known)))).sum() <= 1 + 1e-6
    assert suffix_tree.score(docs, "doc_id", "text", suffix_tree.fit(empty(docs), "text")).count() == docs.count()


def test_suffix_tree_keeps_what_occurs_twice_at_any_size(spark, monkeypatch):
    """Words seen twice in 1,200,001 tokens (a bar by share would be above two) and scores that do not depend on the bounds."""
    rows = [(i, "filler " * 59_999 + "filler") for i in range(20)] + [(50, "quokka zebra yonder quokka zebra yonder"), (51, "zebra quokka"), (52, "quokka zebra yonder")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id <= 50")
    tree = suffix_tree.fit(train, "text")
    got = {r.doc_id: r for r in suffix_tree.score(df, "doc_id", "text", tree).collect()}
    assert got[52].score > got[52].base_score + 5
    q, z, y = (tree[0].known[w] for w in (b"quokka", b"zebra", b"yonder"))
    assert (q,) in tree[0].held[0] and (q, z) in tree[0].held[1]
    # word by word in the state of the longest context
    want = tree[0].base[q] + tree[0].below(1, np.array([q]), np.array([z]))[0] + tree[0].below(2, np.array([q * tree[0].size + z]), np.array([y]))[0]
    want += tree[0].below(2, np.array([z * tree[0].size + y]), np.array([tree[0].known[suffix_tree.END]]))[0]
    assert got[52].score == pytest.approx(want)
    monkeypatch.setattr(suffix_tree, "MOST", 2)
    monkeypatch.setattr(suffix_tree, "HOT", 1)
    monkeypatch.setattr(suffix_tree, "BITS", 1)
    bound = {r.doc_id: r for r in suffix_tree.score(df, "doc_id", "text", suffix_tree.fit(train, "text")).collect()}
    assert all(bound[k].score == pytest.approx(got[k].score) and bound[k].n_known == got[k].n_known for k in got)


def test_hash_equals_that_of_spark(spark):
    rows = [(0, -1), (5, 7), (-(2**63), 2**63 - 1)]
    want = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert suffix_tree.hashed(*np.array(rows, np.int64).T.copy()).tolist() == want


def test_similar_sets_against_brute_force(spark, docs):
    rng = random.Random(11)
    more = []
    for g in range(25):
        base = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.choice([5, 8, 10, 11, 14, 20, 30, 60]))]
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.choice([0, -1, rng.randrange(len(own))])] = "new" + str(rng.randint(0, 99))
            more.append((1000 + len(more), " ".join(own + ["end"] * rng.randint(0, 1))))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {}
    for key, value in texts(rows).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in value or ""))
        sets[key] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    near = {k: {k} for k in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            near[a].add(b), near[b].add(a)
    want = {}
    for key in sorted(sets):
        todo, seen = [key], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        want[key] = (len(sets[key]), min(seen))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.group(rows, "doc_id", "text").collect()} == want
    assert jaccard_join.group(empty(docs), "doc_id", "text").count() == 0


@pytest.mark.parametrize("light", [6, 8, 12])
def test_similar_pairs_share_a_list(light):
    rng = np.random.default_rng(light)
    for _ in range(300):
        size = int(rng.integers(3, 18))
        base = np.unique(rng.integers(1, 2**62, size + 3).astype(np.uint64))
        a, b = (np.sort(rng.permutation(base)[: int(rng.integers(max(1, size - 1), len(base) + 1))]) for _ in range(2))
        if jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b)) and len(a) != len(b) or (len(a) == len(b) and not (a == b).all() and jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b))):
            assert set(jaccard_join.keys(a, light, {}).tolist()) & set(jaccard_join.keys(b, light, {}).tolist())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
