"""Numbers of the language profiles and of the media hash against loops of plain Python."""

import math
import random

import numpy as np
import pytest

from riskloom.llm import langid, media


def plain_bundle(text):
    """Bound and bundled letter triples of a text with a boundary around each word."""
    points, line = [ord(c.lower()[0]) if c.isalpha() else 0 for c in f" {text or ''} "], []
    for p in points:  # a run of other characters is one boundary
        if p or not line or line[-1]:
            line.append(p)
    out = [0] * langid.WIDTH
    for a, b, c in zip(line, line[1:], line[2:]):
        if a or b or c:
            va, vb, vc = (langid.letter_vector(x).tolist() for x in (a, b, c))
            out = [o + va[k - 2] * vb[k - 1] * vc[k] for k, o in enumerate(out)]
    size = math.sqrt(sum(x * x for x in out))
    return [x / size if size else 0.0 for x in out]


def test_bundles_equal_plain_ones():
    rng = random.Random(3)
    texts = [None, "", "12 !", "a", "Über ÉTÉ 9x9", "aaaa", "日本 go"] + ["".join(rng.choice("abcde é9. ") for _ in range(rng.randint(0, 40))) for _ in range(langid.GROUP + 5)]
    got = langid.Bundler().bundle(texts)
    for text, row in zip(texts, got):
        assert row.tolist() == pytest.approx(plain_bundle(text), abs=1e-5)
    assert not got[:3].any()


def plain_hash(samples):
    height, width = len(samples), len(samples[0])
    low = []
    for u in range(8):
        for v in range(8):
            total = 0.0
            for y in range(height):
                for x in range(width):
                    total += samples[y][x] * math.cos(math.pi * u * (y + 0.5) / height) * math.cos(math.pi * v * (x + 0.5) / width)
            low.append(round(total, 6))
    rest = sorted(low[1:])
    middle = rest[len(rest) // 2]
    bits = "".join("1" if x > middle else "0" for x in low)
    return f"{int(bits, 2):016x}"


def test_media_hash_equals_plain_sums():
    rng = random.Random(5)
    for height in (1, 3, 10):
        samples = [[rng.randrange(256) for _ in range(media.WIDTH)] for _ in range(height)]
        assert media.cosine_hash(np.array(samples, np.uint8)) == plain_hash(samples)
