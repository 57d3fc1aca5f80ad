"""Numbers of words, hashes of n-grams and packed batches against plain versions."""

import random

import numpy as np
import pyarrow as pa

from riskloom.llm import suffix_tree


def test_numbers_of_words_that_share_slots():
    words = [b"w%d" % i for i in range(5_000)]
    numbers = suffix_tree.Numbers({w: i for i, w in enumerate(words[:3_000])})
    hashes = suffix_tree.hashes_of(words)
    got = numbers(hashes).tolist()
    assert got[:3_000] == list(range(3_000)) and len({int(h) & len(numbers.slots[0]) - 1 for h in hashes[:3_000]}) < 3_000
    assert got[3_000:] == (hashes[3_000:] | np.uint64(1 << 63)).view(np.int64).tolist()
    assert suffix_tree.Numbers({})(hashes[:3]).tolist() == (hashes[:3] | np.uint64(1 << 63)).view(np.int64).tolist()


def test_hashes_go_on_from_their_beginning():
    a, b, c = (np.random.default_rng(i).integers(-(1 << 62), 1 << 62, 50) for i in range(3))
    assert (suffix_tree.hashed(c, first=suffix_tree.hashed(b, first=suffix_tree.hashed(a))) == suffix_tree.hashed(a, b, c)).all()


def test_filter_lets_both_places_pass():
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 4_000)
    held = np.zeros(1 << 16, bool)
    for shift in (0, 32):
        held[(keys[:2_000].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << 16) - 1)] = True
    want = [all(held[(int(k) % 2**64 >> shift) & 0xFFFF] for shift in (0, 32)) for k in keys]
    assert suffix_tree._passes(np.packbits(held), keys).tolist() == want and all(want[:2_000]) and not all(want)


def test_batches_stay_small_and_keep_all_rows():
    rng = random.Random(2)
    rows = [(i, rng.randbytes(rng.randint(0, 3_000))) for i in range(500)]
    out = list(suffix_tree._batches(iter(rows), {"a": pa.int64(), "b": pa.binary()}, 20_000))
    assert [(x["a"], x["b"]) for batch in out for x in batch.to_pylist()] == rows and len(out) > 20
    assert all(batch.nbytes < 40_000 for batch in out) and not list(suffix_tree._batches(iter([]), {"a": pa.int64()}))


def test_joined_arrays():
    held = [np.arange(i, i + 2 * n).reshape(2, n) for i, n in ((0, 3), (5, 0), (9, 4))]
    want = np.concatenate(held, 1)
    assert (suffix_tree._joined(held) == want).all() and not held


def test_order_of_keys_that_share_leading_bits():
    rng = np.random.default_rng(4)
    wide, close = rng.integers(0, 1 << 64, 3_000, np.uint64), (np.uint64(7) << np.uint64(40)) + rng.integers(0, 900, 3_000).astype(np.uint64)
    for keys in (wide, close, np.concatenate([close, wide]), np.zeros(5, np.uint64), wide[:1], wide[:0]):
        assert suffix_tree._order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
        assert all((x == y).all() for x, y in zip(suffix_tree._distinct(keys), np.unique(keys, return_index=True, return_counts=True)))
