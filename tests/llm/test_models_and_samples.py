"""Classifiers on held-out rows, sampled segmentations against full enumeration, all columns of media, shards, the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from voxlake.llm import jpeg, media, pieces, sharding, subword, toxicity

RNG = np.random.default_rng(9)
PLAIN = ["river", "stone", "morning", "letter", "garden", "window", "travel", "bread", "music", "paper"] * 3


def text(words, n=30):
    return " ".join(RNG.choice(words, n))


def labelled(spark, kinds, column, rows=600):
    """Documents of two kinds of words, odd ids the second, with the label of the kind."""
    docs = [(k, text(kinds[k % 2])) for k in range(rows)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in docs], f"doc_id long, {column} int")
    return spark.createDataFrame([(k, t, "x", 0.5) for k, t in docs], "doc_id long, text string, y string, score double"), labels


def test_quality_of_held_out_documents(spark):
    docs, labels = labelled(spark, [PLAIN + ["zxqv", "click", "buy"] * 4, PLAIN + ["chapter", "because", "theory"] * 4], "quality")
    rows = [r for r in subword.quality(docs, labels).collect() if r.held_out]
    assert len(rows) > 80 and np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = subword.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in subword.quality(docs, labels).where("predicted = 1").collect()}


def test_quality_gradient():
    """One step on one row moves the class vectors along the finite-difference gradient of the loss."""
    ids, n = np.array([3, 7]), np.array([1, 2])
    before = subword.train([(ids, n, 1)], epochs=0)
    after = subword.train([(ids, n, 1)], epochs=30)
    assert after.score([b""])[0] > before.score([b""])[0] and after.table[ids].sum() > before.table[ids].sum()


def test_toxicity_of_held_out_documents_and_swaps(spark):
    docs, labels = labelled(spark, [PLAIN, PLAIN + ["vile", "scum", "filth"] * 3], "toxic")
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.95


def test_penalty_closes_the_gap_between_groups():
    """`muslims` only occurs in toxic rows; with the penalty a neutral mention scores as one of another group."""
    rows = [(set(text(PLAIN, 8).encode().split()) | ({b"vile", b"muslims"} if k % 2 else set()), k % 2) for k in range(400)]
    gap = {p: abs(np.subtract(*[m.score(f"the {g} in the garden") for g in ("muslims", "hindus")])) for p in (0.0, 50.0) for m in [toxicity.train(rows, toxicity.IDENTITY_TERMS, p)]}
    assert gap[50.0] < 0.1 * gap[0.0] and gap[0.0] > 0.05


def segmentations(v, word):
    """(ids, probability) of every path through the lattice of a text of one word, by plain recursion."""
    codes = pieces.codes(word).tolist()
    names = {}
    for i in range(len(v.offset) - 1):
        raw = v.flat[v.offset[i] : v.offset[i + 1]].tobytes()
        if i not in v.byte_id:
            names.setdefault(raw, i)
    chars = [pieces.code_bytes(c) if c != pieces.SPACE else b" " for c in codes]

    def paths(at):
        if at == len(chars):
            return [((), 0.0)]
        out = []
        for k in range(1, v.longest + 1):
            i = names.get(b"".join(chars[at : at + k]))
            if i is not None and at + k <= len(chars):
                out += [((i, *rest), v.score[i] + s) for rest, s in paths(at + k)]
        return out

    found = paths(0)
    total = np.logaddexp.reduce([s for _, s in found])
    return {ids: float(np.exp(s - total)) for ids, s in found}


@pytest.mark.parametrize("long", [48, 3])
def test_samples_follow_the_lattice(monkeypatch, long):
    """First samples are exact, samples are distinct, and inclusion scores make the weighted sums unbiased."""
    monkeypatch.setattr(pieces, "LONG", long)
    v = pieces.vocabulary(pieces.MODEL)
    exact = segmentations(v, "onward")
    n = 4000 if long > 3 else 1500
    drawn = pieces.sample_batch(["onward"] * n, list(range(n)), 3, v)
    first = {}
    for rows in drawn:
        ids = [tuple(r[3].tolist()) for r in rows]
        assert len(set(ids)) == 3 and all(i in exact for i in ids) and [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)
        assert all(abs(r[0] - np.log(exact[i])) < 1e-9 for r, i in zip(rows, ids, strict=True))
        first[ids[0]] = first.get(ids[0], 0) + 1
    for ids, p in exact.items():
        if p > 0.01:
            assert abs(first.get(ids, 0) / n - p) < 4 * np.sqrt(p / n)
    totals = np.array([sum(np.exp(r[0]) / r[2] for r in rows) for rows in drawn])
    lengths = np.array([sum(np.exp(r[0]) / r[2] * len(r[3]) for r in rows) for rows in drawn])
    assert abs(totals.mean() - 1) < 4 * totals.std() / np.sqrt(n) + 0.01
    assert abs(lengths.mean() - sum(p * len(i) for i, p in exact.items())) < 4 * lengths.std() / np.sqrt(n) + 0.02


def test_fewer_segmentations_than_samples_and_long_words(spark):
    v = pieces.vocabulary(pieces.MODEL)
    emoji, unspaced = "\U0001f600" * 60, "".join(RNG.choice(list("abcdefgh"), 30_000))
    one, many = pieces.sample_batch([emoji, unspaced], [1, 2], 3, v)
    assert len(one) == 1 and one[0][2] == 1.0 and len(many) == 3
    assert all(pieces.decode(r[3], v) == unspaced for r in many) and pieces.decode(one[0][3], v) == emoji
    # A text's samples do not depend on its batch.
    assert [r[3].tolist() for r in pieces.sample_batch([unspaced], [2], 3, v)[0]] == [r[3].tolist() for r in many]
    docs = spark.createDataFrame([(1, unspaced), (2, "a b"), (3, None)], "doc_id long, text string")
    back = pieces.decoded(pieces.samples(docs, 2)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(1, unspaced), (2, "a b"), (3, "")}


def test_all_columns_of_media(spark):
    texts = [None, "", "a", "é" * 300, "x" * 576, text(PLAIN, 900), text(PLAIN, 900)]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.store(docs)
    kept = {r.doc_id: bytes(r.media) for r in stored.collect()}
    tensors = {r.doc_id: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in media.tensors(stored).collect()}
    for r in media.read(stored).collect():
        data = (texts[r.doc_id] or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 or (576 if not data else 0))
        m, t = kept[r.doc_id], tensors[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" and b"\xff\xc2" in m
        r_, g, b = t.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        assert r.feature == f"{t.shape[0]}x{t.shape[1]} r={r_} g={g} b={b} crc={zlib.crc32(t.tobytes()):08x}"
        assert np.array_equal(t, jpeg.rgb(jpeg.read_coefficients(m)))


def test_shards_are_written_where_they_are_placed(spark, tmp_path):
    df = spark.createDataFrame([(k % 50, "copy", 1) for k in range(400)], "doc_id long, text string, slot int")
    where = {r.doc_id: r.shard for r in sharding.place(df, "doc_id", 4, 101).collect()}
    sharding.write_shards(df, "doc_id", str(tmp_path / "s"), 4, 101, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(back) == 400 and all(r.shard_ == where[r.doc_id] for r in back)


def test_pipeline(spark, tmp_path):
    own = lambda n: " ".join("q%x" % k for k in RNG.integers(0, 1 << 40, n))
    passage, item, base = own(60), own(15), own(200)
    rows = [(1, base), (2, base), (3, " ".join(base.split()[:-2]) + " " + own(2)), (4, own(40) + " " + passage), (5, passage + " " + own(30)), (6, own(20) + " " + item + " " + own(20)), (7, own(50)), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 4, 5, 7, 8} and all(r.round_trip for r in out)
    v = pieces.vocabulary(pieces.MODEL)
    first = {r.doc_id: r for r in out if r["sample"] == 1}
    rest = " ".join(rows[4][1].split()[60:])
    expected = pieces.sample_batch([" " + rest], [5], 2, v)[0][0][3]
    assert first[5].ids_sha256 in {hashlib.sha256(pieces.sample_batch([t], [5], 2, v)[0][0][3].astype("<i4").tobytes()).hexdigest() for t in (rest, " " + rest)} and len(expected)
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(empty / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
