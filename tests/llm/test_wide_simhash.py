"""Near copies by similarity: partitions of wide fingerprints, and groups against all pairs by exact similarity."""

import numpy as np
import pytest

from voxlake.llm import simhash

RNG = np.random.default_rng(21)


@pytest.mark.parametrize(("n", "recall"), [(1000, 0.9), (200_000, 0.97), (50_000_000, 0.97)])
def test_partitions_meet_pairs_at_the_least_similarity(n, recall):
    both = np.stack([np.full((64, 64), n / 4) + np.eye(64) * n / 4] * 4)
    parts = simhash.allocate_wide(n, both, 0.8, recall)
    bits = [b for p in parts for b in p.bits]
    assert len(bits) == len(set(bits)) == 256 and any(p.threshold >= 0 for p in parts)
    differ = np.arccos(1.6 / 1.8) / np.pi
    a = RNG.integers(0, 1 << 63, (20_000, 4)).astype(np.uint64)
    flips = np.packbits(RNG.random((20_000, 4, 64)) < differ, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    met = np.zeros(20_000, bool)
    for p in parts:
        if p.threshold >= 0:
            met |= np.bitwise_count(p.values(a) ^ p.values(a ^ flips)) <= p.threshold
    assert met.mean() >= recall - 0.01


def own(n):
    return ["u%x" % k for k in RNG.integers(0, 1 << 60, n)]


def test_groups_equal_those_of_all_pairs(spark):
    """Families of copies with 0 to 12 words of 200 exchanged, most of them far from 0.8, among unrelated documents."""
    rows = [(10_000 + k, " ".join(own(150))) for k in range(300)] + [(20_000, None), (20_001, ""), (None, "a b c")]
    for family in range(12):
        base = own(200)
        for k, changed in enumerate((0, 0, 1, 2, 3, 12)):
            words = list(base)
            for at in RNG.choice(200, changed, replace=False):
                words[at] = own(1)[0]
            rows.append((family * 10 + k, " ".join(words)))
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, node string").repartition(5)
    sets = [(d, set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False))) for d, t in rows if d is not None and d < 1000]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if len(s & t) >= 0.8 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    kept = {r.doc_id for r in simhash.keep_first(docs, 5, 20, 4, 54, 0.8, 0.97).collect()}
    assert {d for d in kept if d is not None and d < 1000} == {find(d) for d, _ in sets}
    assert sum(1 for d in kept if d is not None and 10_000 <= d < 20_000) == 300 and 20_000 in kept and 20_001 not in kept and None in kept


def test_empty(spark):
    assert simhash.keep_first(spark.createDataFrame([], "doc_id long, text string"), 5, 20, 4, 54, 0.8, 0.97).count() == 0
