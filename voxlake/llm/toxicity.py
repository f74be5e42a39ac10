"""Operator 10: counterfactual-regularised toxicity classifier.

A logistic model over the distinct lower-cased words and word stems of a text. Every labelled text that mentions an identity term gets
counterfactual twins in which each term is swapped for another term of its set. The loss is the logistic loss plus
`penalty` times the squared change of the logit between text and twin, so a term that merely co-occurs with toxic texts in
the labels earns no weight of its own and a neutral mention of a group stays neutral. Words that no training text holds
weigh nothing. Trained in numpy by proximal gradient steps (the L1 term removes words without evidence); the words that keep
a weight, a few hundred, are all that is broadcast, and `most_words` bounds them.

Null and empty texts have no words and score the prior. Repeated rows score alike, ties are of no concern, an empty table
gives an empty result, and without labelled rows every score is below 1e-12. Only doc_id and text are read, so other columns never
clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import WORD_BYTES, bounded, held_out, labelled_sample, lean, text_bytes

#: Sets of terms that may stand for each other; a parameter of `fit`.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden"),
)


def words(text: str | None) -> set[bytes]:
    """The distinct words, and the stems (first 6, 7 and 8 bytes, marked by a star) of those that are longer."""
    found = set(text_bytes(text).translate(WORD_BYTES).split())
    return found | {w[:n] + b"*" for n in (6, 7, 8) for w in found if len(w) > n}


def twins(found: set[bytes], sets: Sequence[Sequence[bytes]]) -> list[set[bytes]]:
    """The text's words with every identity term moved on by 1, 2, ... places within its set."""
    used = [s for s in sets if not found.isdisjoint(s)]
    out = []
    for k in range(1, max((len(s) for s in used), default=0)):
        swap = {t: s[(i + k) % len(s)] for s in used for i, t in enumerate(s) if t in found}
        if (twin := {swap.get(w, w) for w in found}) != found:
            out.append(twin)
    return out


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(map(get, self.weights.keys() & words(text)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(
    rows: list[tuple[set[bytes], int]], terms=IDENTITY_TERMS, penalty: float = 2.0, l1: float = 5e-4, toxic_weight: float = 4.0, steps: int = 200, most_words: int = 100_000,
) -> Model:
    if not rows:
        return Model(-30.0)
    sets = [[t.encode() for t in s] for s in terms]
    count: dict[bytes, int] = {}
    for w, _ in rows:
        for x in w:
            count[x] = count.get(x, 0) + 1
    vocabulary = sorted((w for w, n in count.items() if n >= 2), key=lambda w: (-count[w], w))[:most_words]
    number = {w: i for i, w in enumerate(vocabulary)}
    for s in sets:  # terms that only twins hold
        for t in s:
            number.setdefault(t, len(number))
    names = list(number)

    def matrix(each: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        ids = [sorted(number[x] for x in w if x in number) for w in each]
        return np.array([i for r in ids for i in r], np.int64), np.repeat(np.arange(len(ids)), [len(r) for r in ids])

    cols, at = matrix([w for w, _ in rows])
    pairs = [(k, t) for k, (w, _) in enumerate(rows) for t in twins(w, sets)]
    own = np.array([k for k, _ in pairs], np.int64)
    twin_cols, twin_at = matrix([t for _, t in pairs])
    y = np.array([v for _, v in rows], float)
    n, size = len(rows), len(names)
    weight = np.where(y > 0, toxic_weight, 1.0)
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    seen, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(at, w[cols], minlength=n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(cols, r[at], minlength=size) / n
        if len(own):
            # The gap between a text and its twin, pulled to zero from both sides.
            gap = z[own] - np.bincount(twin_at, w[twin_cols], minlength=len(own)) - b
            pull = 2 * penalty * gap / len(own)
            g += np.bincount(cols, np.bincount(own, pull, minlength=n)[at], minlength=size)
            g -= np.bincount(twin_cols, pull[twin_at], minlength=size)
        seen += g * g
        rate = 0.5 / np.sqrt(seen)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        seen_b += r.mean() ** 2
        b -= 0.1 / np.sqrt(seen_b) * r.mean()
    return Model(float(b), {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, terms=IDENTITY_TERMS, penalty: float = 2.0) -> Model:
    """Trains on at most `sample_rows` labelled rows, whose word sets are made on the executors."""

    @lean
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "words": [b" ".join(sorted(words(t))) for t in pdf.text]})

    found = labelled_sample(docs, labels, "toxic", sample_rows).mapInPandas(counted, "doc_id long, y int, words binary").collect()
    rows = sorted((r.doc_id, r.y, bytes(r.words)) for r in found)
    return train([(set(w.split()), min(1, max(0, y))) for _, y, w in rows], terms, penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; score is the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": [shared.value.score(t) for t in pdf.text]})

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
