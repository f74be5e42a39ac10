"""Substring dedup: common passages in many surroundings, and the parts of the index against plain searches."""

import numpy as np
import pytest

from tests.llm import brute
from voxlake.llm import bloom, substring_dedup
from voxlake.llm.fm_index import FmIndex, Marks, Minima

RNG = np.random.default_rng(3)


def own(n):
    return " ".join("v%x" % k for k in RNG.integers(0, 1 << 60, n))


def crowd(n, line):
    """Documents around one line: different surroundings, and some that share what stands before or after it."""
    before, after = own(60).split(), own(60).split()
    rows = []
    for k in range(n):
        x, y = int(RNG.integers(0, 60)), int(RNG.integers(0, 60))
        left = own(8) + " " + " ".join(before[x:]) if k % 3 == 0 else own(int(RNG.integers(0, 45)))
        right = " ".join(after[:y]) + " " + own(8) if k % 2 == 0 else own(int(RNG.integers(0, 45)))
        rows.append((k * 3 + 1, f"{left} {line} {right}"))
    return rows + [(2, rows[4][1]), (5000, rows[4][1]), (5001, " ".join(rows[4][1].split()[3:]))]


@pytest.mark.parametrize(("split", "n", "words"), [(2, 60, 12), (5, 60, 30), (8, 60, 70), (256, 700, 49)])
def test_common_lines_are_dealt_out_by_longer_runs(spark, monkeypatch, split, n, words):
    monkeypatch.setattr(substring_dedup, "SPLIT", split)
    rows = crowd(n, own(words))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, substring_dedup.report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert found == sorted(brute.without_repeats(rows))
    assert sum(r[2] for r in found) > 0


def test_without_bloom_filters(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 0)
    rows = crowd(20, own(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.report(docs).collect())) == sorted(brute.without_repeats(rows))


def test_halves_nest_down_to_single_windows():
    for level in range(6):
        assert set(substring_dedup.halves(level)) <= set(substring_dedup.halves(level + 1))
    assert substring_dedup.halves(6).tolist() == list(range(42))


@pytest.mark.parametrize("length", [2, 7, 50])
def test_window_minima(length):
    parts = [RNG.integers(1, 3, int(n)) for n in RNG.integers(length, length + 90, 30)] + [np.ones(length + 20, np.int64)] * 2
    weight = RNG.integers(-5, 1 << 60, len(parts))
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    least, offset = FmIndex(flat, np.repeat(weight, sizes + 1), length).window_minima(flat, first, sizes - length + 1)
    plain = {}
    for p, w in zip(parts, weight.tolist(), strict=True):
        for k in range(len(p) - length + 1):
            key = tuple(p[k : k + length].tolist())
            plain[key] = min(w, plain.get(key, w))
    for p, a in zip(parts, offset.tolist(), strict=False):
        assert least[a : a + len(p) - length + 1].tolist() == [plain[tuple(p[k : k + length].tolist())] for k in range(len(p) - length + 1)]


def test_marks_and_minima():
    marks = RNG.random(1000) < 0.02
    marks[[0, 999]] = True
    at, places = np.arange(999), np.flatnonzero(marks)
    m = Marks(marks)
    assert m.upto(at).tolist() == [int(places[places <= k].max()) for k in at]
    assert m.after(at).tolist() == [int(places[places > k].min()) for k in at]
    values = RNG.integers(-100, 100, 777)
    start = RNG.integers(0, 777, 5000)
    stop = start + 1 + RNG.integers(0, 777, 5000) % (777 - start)
    assert Minima(values).of(start, stop).tolist() == [int(values[a:b].min()) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
