"""The corpus pipeline: quality filter, near-dedup, substring dedup, decontamination, segmentation sampling.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. `run` writes each stage's result
to the shared folder and rereads it as the next one's docs, so a lost executor costs no finished stage. Executors give back
what the stage before has grown of their heaps before the next one starts, so a stage needs no more memory than by itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.llm import decontamination, pieces, simhash, substring_dedup, subword
from voxlake.llm.common import give_back, stored, table

#: Near copies: sets of shingles of 5 words, exact similarity 0.8 or more. Fingerprints only choose the pairs that are looked at.
#: Those of two sets at 0.8 differ in 38.8 of 256 bits with a deviation of 5.7, and in 9.7 of the first 64 with one of 2.9;
#: the partitions that are probed meet such a pair with a probability of 0.97.
SHINGLE_WORDS, FIRST_LANE_BITS, LANES, ALL_BITS, SIMILARITY, RECALL = 5, 20, 4, 54, 0.8, 0.97


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    """The same stage, with executors that have given back what the steps before it left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@afresh
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return subword.keep_good(docs, table(spark, sf_dir, "labels"))


@afresh
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; rows without an id come last."""
    return simhash.keep_first(docs, SHINGLE_WORDS, FIRST_LANE_BITS, LANES, ALL_BITS, SIMILARITY, RECALL)


@afresh
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has too go; every document stays."""
    return substring_dedup.strip(docs).withColumn("n_chars", F.length("text").cast("long"))


@afresh
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@afresh
def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document that is left, decoded again."""
    return pieces.report(docs)


STAGES = [
    ("quality", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated), ("pieces", sample_segmentations),
]

#: The classifier and the sampling are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
