"""The operators against plain versions of their contracts, over small documents with nulls, empties, ties and repeats."""

import numpy as np
import pytest

from tests.llm import brute
from voxlake.llm import decontamination, media, pieces, sharding, simhash, substring_dedup, subword, token_counts, toxicity, url_filter

RNG = np.random.default_rng(5)
VOCABULARY = ["w%d" % k for k in range(400)] + ["Étude", "straße", "naïve", "A-B", "tab\tbed", "x y"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


@pytest.fixture(scope="session")
def rows():
    shared, base = prose(70), prose(200)
    texts = [None, "", "  \n", "one", prose(3), base, base, base.replace("w1 ", "w2 "), prose(40) + " " + shared + " " + prose(9), shared + " " + prose(30), prose(60) + " " + shared, "same " * 300, "same " * 120, prose(5000)]
    return [(k * 7 + 1, t) for k, t in enumerate(texts)] + [(8, ""), (36, base)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, part int, fingerprint string").repartition(3)


def got(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_decontamination(spark, docs, rows):
    items = [(1, rows[5][1][:300]), (2, "w1 w2"), (3, None), (4, "..."), (5, rows[9][1]), (2, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted(brute.contaminated(rows, items), key=str)
    assert got(decontamination.report(docs, benchmark), names) == expected
    assert decontamination.keep_clean(docs, benchmark).count() == sum(not r[-1] for r in expected)
    found = decontamination.spans(docs, benchmark).collect()
    texts = dict(rows)
    assert found and all(r.found in texts[r.doc_id] for r in found)


def test_substring_dedup(docs, rows):
    assert got(substring_dedup.report(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(brute.without_repeats(rows), key=str)
    assert substring_dedup.strip(docs).count() == len(rows)


def test_simhash(docs, rows):
    assert got(simhash.report(docs), ["doc_id", "fingerprint", "component_id"]) == sorted(brute.simhash(rows), key=str)
    kept = {r.doc_id for r in simhash.keep_first(docs, 5, 14, 4, 44).collect()}
    assert {36} <= kept and 43 not in kept and 50 not in kept


def test_forest_equals_components_of_all_links():
    f = np.concatenate([RNG.integers(0, 1 << 62, 1500, dtype=np.uint64), np.uint64(1) << RNG.integers(0, 60, 1500).astype(np.uint64)])[:, None]
    edges = np.concatenate(simhash.forest(f, 2))
    assert all((f[a, 0] ^ f[b, 0]).item().bit_count() <= 2 for a, b in edges.tolist())
    assert len(edges) == 1499


def test_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    odd = spark.createDataFrame([(None, "a b c"), (4, None), (None, None)], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], schema)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for f in (substring_dedup.report, simhash.report, pieces.report, token_counts.count_tokens, lambda d: decontamination.report(d, items), lambda d: subword.quality(d, labels), lambda d: toxicity.toxicity(d, labels), lambda d: sharding.place(d, "doc_id"), lambda d: media.read(media.store(d))):
        assert f(odd).count() >= 3 and f(none).count() == 0


def test_media_round_trip(docs, rows):
    found = {r.doc_id: r for r in media.read(media.store(docs)).collect()}
    for doc, text in rows[:14]:
        data = media.payload((text or "").encode())
        r = found[doc]
        assert (r.payload_bytes, r.payload_sha256) == (len(data), __import__("hashlib").sha256(data).hexdigest())


def test_token_counts(docs, rows):
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    expected = sorted(((d, len(encode(t or ""))) for d, t in rows), key=str)
    assert got(token_counts.count_tokens(docs, block_tokens=64), ["doc_id", "n_tokens"]) == expected


def test_pieces_round_trip(docs, rows):
    out = pieces.report(docs).collect()
    assert all(r.round_trip and 0 < r.inclusion <= 1 for r in out)
    assert len({(r.doc_id, r.ids_sha256) for r in out if r.n_pieces > 20}) == len({(r.doc_id, r["sample"]) for r in out if r.n_pieces > 20})


def test_lookup_table_is_even_and_stable():
    owners = sharding.lookup_table(sharding.shard_names(8), 1009)
    assert set(np.bincount(owners)) <= {126, 127}
    fewer = sharding.lookup_table(sharding.shard_names(7), 1009)
    assert sum(a != b for a, b in zip(owners, fewer, strict=True) if a < 7) < 300


def test_url_rules(spark):
    urls = ["http://A.com/en/x", "http://example.com/en/7?q", "http://other.net/de/1", "http://example.net/de/8", "no", None, "http://cheap-pills.io/a?utm_x=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(pages, url_filter.junk_list(pages)).collect()}
    assert [found[k].verdict for k in range(7)] == ["block", "allow", "allow", "block", "allow", "allow", "block"]
    assert found[0].host == "a.com" and found[1].rule == "example.com/en/7" and found[5].host == ""
