"""Pairs that sketches cannot rule out: all are found, in memory that hangs neither on the pairs of a
block nor on the longest sketch."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from riskweave.llm import jaccard


def _bucket(docs, words, seed, long=0):
    """Rows and sketches of one bucket whose documents are components of their own, some nearly alike."""
    r = np.random.default_rng(seed)
    made = [r.integers(-(1 << 31), 1 << 31, words).astype(np.int32) for _ in range(docs)]
    for i in range(0, docs - 1, 7):
        made[i + 1] = made[i].copy()
        made[i + 1][0] ^= 5
    if long:
        made[-1] = r.integers(-(1 << 31), 1 << 31, long).astype(np.int32)
    ids = np.arange(docs, dtype=np.int64) * 3 + 1
    one = pd.DataFrame({"key": 9, "q": 0, "m": 0, "side": 0, "id": ids, "up": 0, "comp": ids})
    rows = pd.concat([one.iloc[1:], one.assign(side=1)], ignore_index=True)
    return rows, pd.DataFrame({"id": ids, "up": 0, "n": [4 * len(x) for x in made], "sketch": made})


def _brute(rows, made, num, den):
    s, n = dict(zip(made["id"], made["sketch"])), dict(zip(made["id"], made["n"]))
    out = set()
    for _, b in rows.groupby(["key", "q", "m"]):
        for x in b[b["side"] == 0].itertuples():
            for y in b[b["side"] == 1].itertuples():
                if x.comp != y.comp and len(s[x.id]) == len(s[y.id]) and int(np.bitwise_count(s[x.id] ^ s[y.id]).sum()) <= (n[x.id] + n[y.id]) * (den - num) // (num + den):
                    out.add((min(x.id, y.id), max(x.id, y.id)))
    return out


@pytest.mark.parametrize("listed", [1, 50, 1 << 18])
def test_pairs_are_those_of_brute_force(monkeypatch, listed):
    monkeypatch.setattr(jaccard, "_LISTED", listed)
    rows, made = _bucket(23, 5, 1, long=8)
    more = rows[rows["id"] % 2 == 1].assign(key=10, m=2)  # most pairs meet again elsewhere
    lone = rows[(rows["side"] == 1) | (rows["id"] == 4)].assign(key=11)  # one outsider, the rest members alone
    rows = pd.concat([rows, more, lone], ignore_index=True).sample(frac=1, random_state=2)
    got = jaccard._compare(80, 100)((), rows, made)
    pairs = list(zip(got["a"].tolist(), got["b"].tolist()))
    assert len(pairs) == len(set(pairs)) and set(pairs) == _brute(rows, made, 80, 100) and pairs


@pytest.mark.parametrize("docs, words, long", [(2000, 6, 0), (600, 6, 40_000), (60, 40_000, 0)])
def test_memory_is_bounded(docs, words, long):
    rows, made = _bucket(docs, words, 3, long)
    tracemalloc.start()
    try:
        got = jaccard._compare(80, 100)((), rows, made)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) >= (docs - 1) // 7 and peak < 48e6
