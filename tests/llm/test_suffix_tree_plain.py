"""Scores of the suffix tree against a plain version that follows the definition: the longest retained suffix, smoothed by the next shorter one."""

import math
import random
from collections import Counter

import pytest

from riskloom.llm import suffix_tree


class Plain:
    """Next-word probabilities of all contexts up to two words, from lists of words in memory."""

    def __init__(self, texts: list[str]):
        lines = [suffix_tree.words_of(t) for t in texts]
        self.n = Counter(tuple(x[i : i + m]) for x in lines for m in (1, 2, 3) for i in range(len(x) - m + 1))
        words = [k for k in self.n if len(k) == 1]
        self.scale = sum(self.n[k] for k in words) + 0.5 * (len(words) + 1)
        self.after: dict[tuple, list[bytes]] = {}
        for key, n in self.n.items():
            if len(key) > 1 and n >= suffix_tree.LEAST:
                self.after.setdefault(key[:-1], []).append(key[-1])
        self.kept: dict[tuple, bool] = {}

    def share(self, context: tuple, word: bytes) -> float:
        return (self.n[*context, word] - suffix_tree.DISCOUNT) / self.n[context]

    def retained(self, context: tuple) -> bool:
        if context not in self.kept:
            shares = [(self.share(context, w), self.p(context[1:], w)) for w in self.after.get(context, [])]
            self.kept[context] = self.n[context] * sum(s * math.log(s / p) for s, p in shares) >= suffix_tree.DIVERGENCE
        return self.kept[context]

    def p(self, context: tuple, word: bytes) -> float:
        if not context:
            return (self.n[word,] + 0.5) / self.scale
        if not self.retained(context):
            return self.p(context[1:], word)
        if self.n[*context, word] >= suffix_tree.LEAST:
            return self.share(context, word)
        known = self.after[context]
        left, room = 1 - sum(self.share(context, w) for w in known), 1 - sum(self.p(context[1:], w) for w in known)
        return self.p(context[1:], word) * max(left, 1e-9) / max(room, 1e-9)

    def score(self, text: str) -> float:
        words = suffix_tree.words_of(text)
        return sum(math.log10(self.p(tuple(words[max(0, i - 2) : i]), w)) for i, w in enumerate(words))


def _texts(n: int, seed: int) -> list[str]:
    """Word chains with habits, so that contexts of one and of two words diverge, and some words that occur once."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words = [rng.choice("abcdefgh"), rng.choice("abcdefgh")]
        for _ in range(rng.randrange(3, 60)):
            x, y = (ord(w[0]) for w in words[-2:])
            words.append("abcdefgh"[(x + 3 * y) % 8] if rng.random() < 0.7 else "abcdefgh"[y * 5 % 8] if rng.random() < 0.6 else rng.choice("abcdefghijklm"))
        words.insert(rng.randrange(len(words)), f"once{seed}x{k}")
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bounds", [{}, {"MOST": 4, "HOT": 5, "ROOM": 40, "BITS": 1 << 16}])
def test_scores_follow_the_definition(spark, monkeypatch, bounds):
    """With the production bounds, and with bounds so low that words, n-grams and values meet in several buckets."""
    for name, value in bounds.items():
        monkeypatch.setattr(suffix_tree, name, value)
    train = _texts(80, 1)
    asked = [*train[:10], *_texts(25, 2), "", "a", "a b", "unseen words only"]
    plain = Plain(train)
    assert {len(k) for k, kept in plain.kept.items() if kept} == set()
    want = {i: plain.score(t) for i, t in enumerate(asked)}
    assert {len(k) for k, kept in plain.kept.items() if kept} == {1, 2} and not all(plain.kept.values())
    model = suffix_tree.fit(spark.createDataFrame([(t,) for t in train], "text string"), "text")
    rows = suffix_tree.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), "doc_id", "text", model).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_without_training_texts_every_word_is_alike(spark):
    """One unseen word has all the probability: a score of 0."""
    none = spark.createDataFrame([], "text string")
    rows = suffix_tree.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), "doc_id", "text", suffix_tree.fit(none, "text")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in rows) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
