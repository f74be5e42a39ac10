"""Operator 1: quality classifier on supervised subword embeddings.

Words, pairs of adjoining words, and character 3- and 4-grams (spaces mark word ends) hash into one table of learned vectors.
A document is the mean of its vectors, a softmax layer turns the mean into class probabilities, and both are trained by numpy
stochastic gradient descent. Since the output is linear in the mean, scoring needs one number per bucket: `Model.table` holds
the difference of the class logits, 1 MB, which is all that is broadcast.

Null and empty texts have no features and score the model's prior. Repeated rows score alike. An empty table gives an empty
result; with no labelled rows every score is 0.5. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import bounded, by_size, held_out, labelled_sample, lean, text_bytes

BITS, DIM = 18, 8
#: Factor on the vectors' rate: a mean spreads a document's gradient over all its features.
GAIN = 30.0
SCHEMA = "doc_id long, score double"
_MULT = np.uint32(0x9E3779B1)
_STEP = np.uint64(0x100000001B3)
#: Ready for a range of `by_size` and the spaces between its texts; every worker of a pipeline keeps them.
_READY = (1 << 20) + (1 << 12)
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_READY, _STEP))])
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_READY, np.uint64(pow(0x100000001B3, -1, 1 << 64))))])


def powers(table: np.ndarray, n: int) -> np.ndarray:
    """The first n powers; a text longer than the ready table gets one of its own."""
    if n <= len(table):
        return table[:n]
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, table[1]))])


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of features: buckets in text order, and each document's first and end index among them.

    The groups are character 3-grams and 4-grams (a space may be their first or last byte), words, and pairs of adjoining
    words, hashed by exclusive or, so that every word that repeats the one before it shares a bucket."""
    clean = [b" ".join(t.split()) for t in texts]
    buffer = np.frombuffer(b" " + b" ".join(clean) + b"    ", dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in clean])
    gap = buffer == 32
    wide = buffer.astype(np.uint32)
    two = wide[:-1] | wide[1:] << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    gap3 = gap[1 : len(four) + 1]
    shift = np.uint32(32 - BITS)
    for code, bad in ((four & np.uint32(0xFFFFFF), gap3), (four, gap3 | gap[2 : len(four) + 2])):
        ok = np.flatnonzero(~bad)
        h = code[ok]
        h ^= h >> np.uint32(15)
        cut = np.searchsorted(ok, bounds)
        yield (h * _MULT) >> shift, cut[:-1], cut[1:]
    edge = np.flatnonzero(gap)
    first, last = edge[:-1] + 1, edge[1:]
    some = last > first
    first, last = first[some], last[some]
    wide8 = buffer.astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(wide8 * powers(_POWERS, len(buffer)))])
    words = (sums[last] - sums[first]) * powers(_INVERSE, len(buffer) + 1)[first]
    words ^= words >> np.uint64(31)
    words = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    cut = np.searchsorted(first, bounds + 1)
    yield (words.astype(np.uint32) * _MULT) >> shift, cut[:-1], cut[1:]
    pair = (words[1:] ^ words[:-1]).astype(np.uint32)
    pair ^= pair >> np.uint32(16)
    yield ((pair + np.uint32(5)) * _MULT) >> shift, np.minimum(cut[:-1], len(pair)), np.clip(cut[1:] - 1, np.minimum(cut[:-1], len(pair)), len(pair))


def sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their counts."""
    out = []
    for a, b in by_size(texts):
        groups = list(features(texts[a:b]))
        for k in range(b - a):
            out.append(np.unique(np.concatenate([h[x[k] : y[k]] for h, x, y in groups]), return_counts=True))
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in by_size(texts):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for h, x, y in features(texts[a:b]):
                running = np.concatenate([[0.0], np.cumsum(self.table[h], dtype=np.float64)])
                total += running[y] - running[x]
                n += y - x
            out[a:b] = total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent, a document at a time, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, DIM), dtype=np.float32) - 0.5) / DIM
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, n, y = rows[k]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            share = (n / max(1, n.sum())).astype(np.float32)
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * np.float32(0.1) * p
            if len(ids):
                vectors[ids] -= (lr * np.float32(GAIN)) * share[:, None] * down
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500) -> Model:
    """Trains on at most `sample_rows` labelled rows; their features are counted on the executors."""

    @lean
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = sparse([text_bytes(t) for t in pdf.text])
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "y": pdf.y,
                "ids": [r[0].astype(np.int32).tobytes() for r in rows], "n": [r[1].astype(np.int32).tobytes() for r in rows],
            })

    found = labelled_sample(docs, labels, "quality", sample_rows).mapInPandas(counted, "doc_id long, y int, ids binary, n binary")
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.y, bytes(r.ids)))
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.n, np.int32), min(1, max(0, r.y))) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; score is the probability of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": shared.value.score([text_bytes(t) for t in pdf.text])})

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(scored, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject; scored row by row, so repeated ids stay apart."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @lean
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[shared.value.score([text_bytes(t) for t in pdf.text]) >= threshold]

    bounded(docs.sparkSession)
    return docs.mapInPandas(kept, docs.schema)
