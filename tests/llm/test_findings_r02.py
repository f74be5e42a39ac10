"""What the findings of round 2 ask for."""

import numpy as np

import corpus_pipeline
from voxlake.llm import decontamination, pieces, simhash, substring_dedup, subword
from voxlake.llm.common import lean


def test_workers_of_decontamination_give_memory_back(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(decontamination, "lean", lambda step: seen.append(step.__name__) or lean(step))
    docs = spark.createDataFrame([(1, "x alpha beta y"), (2, "gamma"), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, benchmark).collect()) == [2, 3]
    assert sorted((r.doc_id, r.n_hit) for r in decontamination.report(docs, benchmark).collect()) == [(1, 2), (2, 0), (3, 0)]
    assert seen == ["kept", "scan"]


def test_tables_that_workers_keep_are_small_and_longer_texts_get_their_own(monkeypatch):
    kept = [subword._POWERS, subword._INVERSE, pieces._POWERS, pieces._INVERSE]
    assert sum(t.nbytes for t in kept) < 28 << 20
    texts, seed = ["one two  three two", "", "four one"], [1, 2, 3]
    v = pieces.vocabulary(pieces.MODEL)

    def found():
        grams = [x for group in subword.features([t.encode() for t in texts]) for x in group]
        return grams, [[(r[0], r[2], r[3].tolist()) for r in rows] for rows in pieces.sample_batch(texts, seed, 2, v)]

    grams, samples = found()
    for module in (subword, pieces):
        for name in ("_POWERS", "_INVERSE"):
            monkeypatch.setattr(module, name, getattr(module, name)[:3])
    with np.errstate(over="ignore"):
        again, others = found()
    assert samples == others and all(np.array_equal(a, b) for a, b in zip(grams, again, strict=True))


def test_executors_give_memory_back_before_every_stage(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long")
    for name in ("labels", "benchmark"):
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
    for module, name in ((subword, "keep_good"), (simhash, "keep_first"), (substring_dedup, "strip"), (decontamination, "keep_clean"), (pieces, "report")):
        monkeypatch.setattr(module, name, lambda docs, *rest: docs)

    def whole_collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    for _, stage in corpus_pipeline.STAGES:
        before = whole_collections()
        assert [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()] == [1]
        assert whole_collections() > before
