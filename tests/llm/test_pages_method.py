"""Differencing runs for every page, with an article or without: what it deletes, and what the check of the markup changes."""

import random
from hashlib import md5

import pytest

from riskloom.llm import pages


def test_counts_of_every_page_against_brute_force(spark):
    rng = random.Random(8)

    def page(i):
        blocks = "".join(f"<p>Passage {rng.randint(0, 6)}</p>" for _ in range(rng.randint(1, 5)))
        tag = rng.choice(["article", "main", "div", "section"])
        return f'<body><nav>Home</nav><p>About {rng.randint(0, 1)}</p><div class="ad">Buy {rng.randint(0, 3)}</div><{tag}>{blocks}</{tag}><footer>Foot</footer></body>'

    rows = [(i, f"http://{rng.choice('gh')}.example/{rng.choice('ab')}/{rng.randint(0, 30)}", page(i)) for i in range(80)]
    lined = {i: pages.lines_of(html) for i, _, html in rows}
    keys = {i: (url[7], url[16:], md5(repr(lined[i]).encode()).digest()) for i, url, _ in rows}
    by_key = {k: lined[i] for i, k in keys.items()}
    want = {}
    for i, key in keys.items():
        others = sorted(k for k in by_key if k[0] == key[0] and k[2] != key[2])
        near = [max((k for k in others if k < key), default=None), min((k for k in others if k > key), default=None)]
        shares = [-1 if k is None else next((j for j, (a, b) in enumerate(zip(k[1] + "\0", key[1] + "\1")) if a != b)) for k in near]
        own, beside = lined[i], by_key[near[shares[1] > shares[0]]]
        shared = pages.common([x for x, _ in own], [x for x, _ in beside])
        article = any(state == pages.CONTENT for _, state in own)
        kept = {j for j, (_, state) in enumerate(own) if (state == pages.CONTENT if article else state == pages.UNKNOWN and j not in shared)}
        left = set(range(len(own))) - shared
        want[i] = ("\n\n".join(own[j][0] for j in sorted(kept)), len(own), len(shared), len(kept & shared), len(left - kept))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_blocks, r.n_shared, r.n_restored, r.n_rejected) for r in pages.extract(df, "page_id", "url", "html").collect()}
    assert got == want
    assert sum(x[3] for x in want.values()) > 20 and sum(x[4] for x in want.values()) > 20


@pytest.mark.parametrize("tag", ["article", "div"])
def test_passages_that_articles_share_stay_in_articles(spark, tag):
    rows = [(i, f"http://g.example/a/{i}", f"<body><p>Menu</p><{tag}><p>Shared passage</p><p>Own {i}</p></{tag}></body>") for i in range(2)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").collect()}
    assert [got[i].text for i in range(2)] == [f"Shared passage\n\nOwn {i}" if tag == "article" else f"Own {i}" for i in range(2)]
    assert [(r.n_blocks, r.n_shared, r.n_restored, r.n_rejected) for r in got.values()] == [(3, 2, int(tag == "article"), 0)] * 2
