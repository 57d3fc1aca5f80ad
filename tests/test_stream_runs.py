"""Runs of closed windows of a bucket of keys against windows one by one."""

import random

import numpy as np
import pytest

from riskloom.streaming.features import runs_of


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_windows_one_by_one(seed):
    rng = random.Random(seed)
    slide = rng.choice([1, 10])
    size, base = slide * rng.randint(1, 8), slide * rng.randint(-50, 50)
    known_keys = set(rng.sample("abc", rng.randint(0, 2)))
    last = base + slide * rng.randint(-2, 30) if known_keys else None
    places = sorted({(rng.choice("abc"), base + slide * rng.randint(0, 30)) for _ in range(rng.randint(0, 12))}, key=lambda x: x[0] not in known_keys)
    rows = [(k, s, rng.randint(1, 5), rng.choice([1.5, 2.25])) for k, s in places]
    upto, known = base + slide * rng.randint(0, 45), sum(k in known_keys for k, _ in places)
    columns = (np.array([r[i] for r in rows], kind) for i, kind in enumerate((object, np.int64, np.int64, np.float64)))
    got = [((r.key, end), (r.n, r.total)) for r in runs_of(*columns, known, last, size, slide, upto).itertuples() for end in range(r.low, r.high + 1, slide)]
    want = {}
    for k in "abc":
        for end in range(base - 5 * slide, upto + 1, slide):
            own = [r for r in rows if r[0] == k and end - size <= r[1] <= end - slide]
            if own and (k not in known_keys or end > last):
                want[k, end] = (sum(r[2] for r in own), sum(r[3] for r in own))
    assert dict(got) == want and len(got) == len(want)


def test_a_value_that_is_no_number_stays_in_its_windows():
    key, start = np.array(["a", "a", "b"], object), np.array([0, 5, 0])
    out = runs_of(key, start, np.array([1, 1, 1]), np.array([np.nan, 2.0, 3.0]), 0, None, 2, 1, 100)
    assert {(r.key, r.low, r.high): r.total for r in out.itertuples() if r.total == r.total} == {("a", 6, 7): 2.0, ("b", 1, 2): 3.0}
