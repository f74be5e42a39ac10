"""What the first advice found missing: each test failed before."""

import duckdb
import numpy as np
import pytest

from voxlake.llm import decontamination, oracles, simhash, url_filter

RNG = np.random.default_rng(11)


def own(n):
    """Words that no other document has."""
    return " ".join("u%x" % k for k in RNG.integers(0, 1 << 60, n))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.keep_first(docs, 5, 14, 4, 44).collect())


def test_repeated_lines_are_no_near_copies(spark):
    line = own(11)
    rows = [(k, own(300) + f" {line}" * 20) for k in range(6)]
    assert kept(spark, rows) == list(range(6))


def jaccard(a, b):
    a, b = (set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_are_components_of_exact_similarity(spark, monkeypatch):
    """Against all pairs by exact similarity, with pieces and cells made small; replacements leave similarities of 0.6 to 1."""
    monkeypatch.setattr(simhash, "CELL", 3)
    rows = []
    for family in range(8):
        base = own(200).split()
        for k in range(8):
            words = list(base)
            for at in RNG.choice(200, int(RNG.integers(0, 8)), replace=False):
                words[at] = own(1)
            rows.append((family * 100 + k, " ".join(words)))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if jaccard(s, t) >= 0.8:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    # With every bit allowed all pairs are candidates, so only the exact similarity decides.
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (256, 60):
        found = simhash.grouped_sets(docs, 5, 30, 4, most, 0.8).collect()
        least = {}
        for r in found:
            least[r.root] = min(r.id, least.get(r.root, r.id))
        assert {r.id: least[r.root] for r in found} == {d: find(d) for d, _ in rows}


@pytest.mark.parametrize(("a", "b", "linked"), [(range(8), range(10), True), (range(79), range(100), False), (range(4), range(1, 5), False)])
def test_similarity_of_sets_is_exact(a, b, linked):
    assert simhash.similar(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) is linked


def test_one_row_of_each_group_stays(spark):
    """One id with two texts keeps both groups; exact copies without an id become one row, near copies of a named row go."""
    big, a, b, c = (1 << 53) + 1, own(60), own(60), own(60)
    rows = [(5, a), (5, b), (5, b), (9, a), (None, c), (None, c), (None, b), (big, own(60)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs, 5, 14, 4, 44).collect()), key=str)
    assert found == sorted([(5, a), (5, b), (None, c), rows[7], (None, None)], key=str)


def test_every_junk_label_is_listed(spark):
    labels = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]
    urls = [f"http://www.{x}.io/a" for x in labels] + ["http://plain.io/a", "http://not-adult-x.io/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.junk_list(pages)).collect()}
    assert [found[k] for k in range(8)] == ["block"] * 6 + ["allow"] * 2


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_items_without_id_hit_as_in_sql(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    items = [(None, "alpha beta"), (None, "gamma delta"), (7, "beta gamma"), (8, None), (None, None)]
    rows = [(1, "x alpha beta y"), (2, "alpha beta gamma delta"), (3, "beta gamma"), (4, "none of them"), (5, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, kind, values in (("benchmark", "item_id", items), ("documents", "doc_id", rows)):
        con.execute(f"CREATE TABLE {name} ({kind} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    expected = sorted(con.execute(oracles.SQL["op3_decontamination"]).fetchall())
    assert sorted(map(tuple, decontamination.report(docs, benchmark).collect())) == expected
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, benchmark).collect()) == [4, 5]
