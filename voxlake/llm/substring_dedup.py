"""Operator 7: substring dedup with a compressed FM-index per shard.

A window is 50 consecutive words of one document; a word goes when a window that covers it also starts in a document with a
smaller doc_id. Searching every document in the index of every shard would grow with the square of the corpus, so windows are
routed: each has an anchor, the run of 10 words in it with the least hash, which is the same for equal windows. Neighbouring
windows with one anchor form a segment, and all windows of an anchor meet in one shard.

1. Anchors that only one document has cannot repeat. Those of several documents make a Bloom filter sized by their number.
2. Documents pass the filter and leave the segments of possibly shared anchors, without text, neighbouring ones as a chain that
   ends where the content says so. Equal chains are combined before the shuffle: copies of a passage, however many, cost one
   row a task, and a document that has it a row for about eight segments.
3. An anchor with one distinct segment needs no search: all its windows start in the least document that has the segment. The
   others' distinct segments are fetched, with their words, in one more pass (again behind a Bloom filter).
4. Each shard builds an FM-index of the segments of its anchors and streams them through it: backward search gives every
   window's interval, and the least doc_id in it.
5. An anchor with more than `SPLIT` distinct segments (a very common line in ever different surroundings) is too much for one
   shard. Its windows are parted by how many words stand before the anchor, in halves; the windows of a half have more words in
   common than the anchor, and this longer run deals them out anew, equal pieces combined. Runs that are still too common are
   halved again, six times at most: a run of 50 words is a window, and all its pieces are equal. A segment leaves a few pieces
   a halving, not a row a window, and every piece is answered by the same search; the answers are put together on the way back.

The registered query drops words by the windows so found. Null texts have no words; a null doc_id is neither smaller nor
larger than another, so such rows neither lose words nor make others lose some; rows that repeat a doc_id are each judged, and
never against each other; texts of fewer than 50 words lose nothing. An empty table gives an empty result. Only doc_id and
text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxlake.llm.bloom import bloom, maybe
from voxlake.llm.common import bounded, by_size, lean, stored, text_bytes
from voxlake.llm.fm_index import FmIndex

WINDOW, ANCHOR = 50, 10
#: Distinct segments of one run of words above which they are dealt out by longer runs.
SPLIT = 256
#: Words in the segments of a shard, about.
SHARD_WORDS = 150_000
Q1, Q2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BYTE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(base)))])


class Cache:
    """Powers of the hash bases, grown as texts demand."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}

    def get(self, base: int, n: int) -> np.ndarray:
        if len(self.held.get(base, ())) <= n:
            self.held[base] = powers(base, max(n, 1 << 18))
        return self.held[base]


POWERS = Cache()


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of the first word of each text."""
    buffer = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    gap = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stops = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    n = len(buffer)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * POWERS.get(int(BYTE), n)[:n])])
    h = mix((sums[stops] - sums[starts]) * POWERS.get(inverse(int(BYTE)), n)[starts] + (stops - starts).astype(np.uint64))
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, bounds)


def spans(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = POWERS.get(base, len(h))
    return np.concatenate([[np.uint64(0)], np.cumsum(h * p[: len(h)])]), p, POWERS.get(inverse(base), len(h))


def span_hash(sums: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[0][b] - sums[0][a]) * sums[2][a] + (b - a).astype(np.uint64))


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of the texts: text number, first window, number of windows, words before the anchor, anchor, two hashes of all words."""
    h, bounds = word_hashes(texts)
    n = len(h)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "at", "anchor", "s1", "s2")}
    if n < WINDOW:
        return empty
    sums1, sums2 = spans(h, Q1), spans(h, Q2)
    grams = np.arange(n - ANCHOR + 1)
    gram = span_hash(sums1, grams, grams + ANCHOR)
    # The least hash of the 41 anchors in a window, the leftmost of equals: high bits of the hash over the place.
    low = np.uint64((1 << 24) - 1)
    key = (gram & ~low) | (grams.astype(np.uint64) & low)
    reach = WINDOW - ANCHOR + 1
    least, width = key, 1
    while 2 * width <= reach:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: n - WINDOW + 1], least[reach - width : reach - width + n - WINDOW + 1])
    window = np.arange(n - WINDOW + 1)
    place = window + ((least & low).astype(np.int64) - window & int(low))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[: n - WINDOW + 1]
    valid = window + WINDOW <= bounds[1:][text]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    new &= valid
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    breaks = np.flatnonzero(new | ~valid)
    follow = np.append(breaks, n - WINDOW + 1)[np.searchsorted(breaks, first, side="right")]
    count = follow - first
    stop = follow + WINDOW - 1
    return {
        "text": text[first], "start": first - bounds[text[first]], "n": count, "at": place[first] - first, "anchor": gram[place[first]].view(np.int64),
        "s1": span_hash(sums1, first, stop).view(np.int64), "s2": mix(span_hash(sums2, first, stop) + (place[first] - first).astype(np.uint64)).view(np.int64),
    }


def text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def place_key(s1: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(s1.view(np.uint64) + doc.astype(np.uint64) * np.uint64(Q1) + start.astype(np.uint64) * np.uint64(Q2)).view(np.int64)


def each(pdf: pd.DataFrame, most: int = 1 << 18) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts and ids of rows whose id is not null, in ranges of bounded size."""
    pdf = pdf[pdf.doc_id.notna()]
    texts, ids = [text_bytes(t) for t in pdf.text], pdf.doc_id.to_numpy(np.int64)
    for a, b in by_size(texts, most):
        yield texts[a:b], ids[a:b]


# --- the passes -----------------------------------------------------------------------------------------------------------

def shared_anchors(docs: DataFrame) -> DataFrame:
    """(anchor): those that documents of different ids have."""

    @lean
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for texts, ids in each(pdf):
                s = segments(texts)
                yield pd.DataFrame({"anchor": s["anchor"], "doc_id": ids[s["text"]]})

    pairs = docs.select("doc_id", "text").mapInPandas(found, "anchor long, doc_id long")
    return pairs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")


def chains(s: dict[str, np.ndarray]) -> np.ndarray:
    """Where chains begin among the segments: at a gap between windows, at an anchor that says so, and after 64 segments."""
    joined = (s["text"][1:] == s["text"][:-1]) & (s["start"][1:] == s["start"][:-1] + s["n"][:-1]) & (s["anchor"][1:] & 7 != 0)
    first = np.concatenate([np.ones(min(1, len(s["text"])), bool), ~joined])
    run = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return np.flatnonzero(first | ((np.arange(len(first)) - run) % 64 == 0))


def shared_chains(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(c1, c2, doc_id, text_key, start, parts) of the chains of segments whose anchor may be shared; parts are their segments."""
    lanes = bloom(shared, "anchor")
    filter_ = docs.sparkSession.sparkContext.broadcast(lanes)

    @lean
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for texts, ids in each(pdf):
                s = segments(texts)
                ok = maybe(filter_.value, s["anchor"])
                s = {k: v[ok] for k, v in s.items()}
                first = chains(s)
                text = s["text"][first]
                keys = np.zeros(len(texts), np.int64)
                for k in np.unique(text):
                    keys[k] = text_key(texts[k])
                packed = np.stack([s["anchor"], s["s1"], s["s2"], s["n"] << 32 | s["at"]], axis=1)
                parts = [packed[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(packed)], strict=True)] if len(first) else []
                hashes = np.array([np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64) for x in parts], np.int64).reshape(-1, 2)
                yield pd.DataFrame({"c1": hashes[:, 0], "c2": hashes[:, 1], "doc_id": ids[text], "text_key": keys[text], "start": s["start"][first], "parts": parts})

    return docs.select("doc_id", "text").mapInPandas(found, "c1 long, c2 long, doc_id long, text_key long, start long, parts binary")


def unchained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c1, c2, rel, anchor, s1, s2, n, at, lo, start, hi): the segments of distinct chains, `rel` windows after their begin."""
    for pdf in batches:
        size = np.array([len(x) // 32 for x in pdf.parts], np.int64)
        packed = np.frombuffer(b"".join(pdf.parts), np.int64).reshape(-1, 4)
        of, n = np.repeat(np.arange(len(pdf)), size), packed[:, 3] >> 32
        before = np.cumsum(n) - n
        rel = before - before[(np.cumsum(size) - size)[of]]
        rows = {c: pdf[c].to_numpy(np.int64)[of] for c in ("c1", "c2", "lo", "hi")}
        yield pd.DataFrame({**rows, "rel": rel, "start": pdf.start.to_numpy(np.int64)[of] + rel, "anchor": packed[:, 0], "s1": packed[:, 1], "s2": packed[:, 2], "n": n, "at": packed[:, 3] & 0xFFFFFFFF})


MEMBERS = "c1 long, c2 long, lo long, hi long, rel long, start long, anchor long, s1 long, s2 long, n int, at int"


def fetched(docs: DataFrame, lanes: np.ndarray | None) -> DataFrame:
    """(anchor, s1, s2, doc_id, start, words) of the places that may be wanted."""
    filter_ = docs.sparkSession.sparkContext.broadcast(lanes)

    @lean
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for texts, ids in each(pdf):
                s = segments(texts)
                ok = maybe(filter_.value, place_key(s["s1"], ids[s["text"]], s["start"]))
                s = {k: v[ok] for k, v in s.items()}
                out, last, words = [], -1, []
                for k, a, n in zip(s["text"].tolist(), s["start"].tolist(), s["n"].tolist(), strict=True):
                    if k != last:
                        last, words = k, texts[k].split()
                    out.append(b" ".join(words[a : a + n + WINDOW - 1]))
                yield pd.DataFrame({"anchor": s["anchor"], "s1": s["s1"], "s2": s["s2"], "doc_id": ids[s["text"]], "start": s["start"], "words": out})

    return docs.select("doc_id", "text").mapInPandas(found, "anchor long, s1 long, s2 long, doc_id long, start long, words binary")


def searched(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: (key, s1, s2, least), the least doc_id of each window of each piece, from the shard's FM-index."""
    parts = [bytes(w).split() for w in pdf.words]
    sizes = np.array([len(p) for p in parts], np.int64)
    number: dict[bytes, int] = {}
    flat = np.zeros(int(sizes.sum() + len(parts)), np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    for a, p in zip(first.tolist(), parts, strict=True):
        flat[a : a + len(p)] = [number.setdefault(w, len(number) + 1) for w in p]
    weight = np.repeat(pdf.lo.to_numpy(np.int64), sizes + 1)
    least, offset = FmIndex(flat, weight, WINDOW).window_minima(flat, first, sizes - WINDOW + 1)
    return pd.DataFrame({"key": pdf["key"], "s1": pdf.s1, "s2": pdf.s2, "least": [least[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]})


def halves(level: int) -> np.ndarray:
    """Bounds of the ranges of words before the anchor after so many halvings; from six on, a range has one number at most."""
    reach = WINDOW - ANCHOR + 1
    return np.unique([reach * c >> level for c in range((1 << level) + 1)])


def split(level: int) -> Callable:
    """Pieces of pieces: (key, s1, s2, n, at, lo, words) of the part with so many words before the anchor, and whose they are:
    (of_key, of_s1, of_s2, from, a window there). The key is the hash of the run that all windows of the whole part have."""
    bounds = halves(level)

    @lean
    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in range(0, len(pdf), 500):
                part = pdf.iloc[x : x + 500]
                words = [bytes(w).split() for w in part.words]
                h, first = word_hashes([bytes(w) for w in part.words])
                n, at = part.n.to_numpy(np.int64), part["at"].to_numpy(np.int64)
                low = np.searchsorted(bounds, at - n + 1, side="right") - 1
                high = np.searchsorted(bounds, at, side="right") - 1
                of = np.repeat(np.arange(len(part)), high - low + 1)
                c = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                # Windows a to b - 1 of the piece have bounds[c] to bounds[c + 1] - 1 words before the anchor.
                a, b = np.maximum(at[of] - bounds[c + 1] + 1, 0), np.minimum(at[of] - bounds[c] + 1, n[of])
                sums1, sums2 = spans(h, Q1), spans(h, Q2)
                anchor = first[of] + at[of]
                run = span_hash(sums1, anchor - bounds[c], anchor - bounds[c + 1] + 1 + WINDOW)
                begin, end = first[of] + a, first[of] + b + WINDOW - 1
                own = part["key"].to_numpy(np.int64).view(np.uint64)[of]
                yield pd.DataFrame({
                    "key": mix(run + own * np.uint64(Q1) + c.astype(np.uint64)).view(np.int64), "s1": span_hash(sums1, begin, end).view(np.int64),
                    "s2": mix(span_hash(sums2, begin, end) + (at[of] - a).astype(np.uint64)).view(np.int64), "n": (b - a).astype(np.int32), "at": (at[of] - a).astype(np.int32),
                    "lo": part.lo.to_numpy(np.int64)[of], "words": [b" ".join(words[k][i:j]) for k, i, j in zip(of.tolist(), a.tolist(), (b + WINDOW - 1).tolist(), strict=True)],
                    **{f"of_{k}": part[k].to_numpy(np.int64)[of] for k in ("key", "s1", "s2")}, "from": a.astype(np.int32),
                })

    return parted


PIECE, SPLITS = ["key", "s1", "s2"], "key long, s1 long, s2 long, n int, at int, lo long, words binary, of_key long, of_s1 long, of_s2 long, from int"


def minima(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(key, s1, s2, least): the least doc_id of each window of each of the distinct pieces (key, s1, s2, n, at, lo, words).

    Windows of pieces with different keys are never equal. `level` is the number of halvings so far."""
    sizes = stored(pieces.groupBy("key").agg(F.count("*").alias("pieces"), F.sum(F.length("words")).alias("bytes")), "sizes")
    told = sizes.agg(F.max("pieces"), F.sum(F.when(F.col("pieces").between(2, SPLIT), F.col("bytes")))).first()
    pieces = pieces.join(sizes.select("key", "pieces"), "key")
    shards = int((told[1] or 0) / 6 / SHARD_WORDS) + 1
    by_index = (
        pieces.where(F.col("pieces").between(2, SPLIT)).select(*PIECE, "lo", "words")
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInPandas(lambda pdf: searched(pdf), "key long, s1 long, s2 long, least array<long>")
    )
    alone = pieces.where("pieces = 1").select(*PIECE, F.expr("array_repeat(lo, n)").alias("least"))
    out = stored(by_index.unionByName(alone), "minima")
    if (told[0] or 0) <= SPLIT:
        return out
    parted = stored(pieces.where(F.col("pieces") > SPLIT).select(*PIECE, "n", "at", "lo", "words").mapInPandas(split(level + 1), SPLITS), "parted")
    distinct = parted.groupBy(*PIECE).agg(F.min("lo").alias("lo"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("words").alias("words"))
    inner = minima(stored(distinct, "pieces"), level + 1)
    whole = (
        parted.select(*PIECE, "of_key", "of_s1", "of_s2", "from").join(inner, PIECE)
        .groupBy("of_key", "of_s1", "of_s2").agg(F.sort_array(F.collect_list(F.struct("from", "least"))).alias("parts"))
        .select(F.col("of_key").alias("key"), F.col("of_s1").alias("s1"), F.col("of_s2").alias("s2"), F.flatten("parts.least").alias("least"))
    )
    return out.unionByName(stored(whole, "minima"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, ranges): per document the ranges [first, last) of windows that start in a smaller document too."""
    bounded(docs.sparkSession)
    shared = stored(shared_anchors(docs), "anchors")
    held = stored(shared_chains(docs, shared), "chains")
    kept = held.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("hi"), F.first("parts").alias("parts"))
    members = stored(kept.select("c1", "c2", "parts", F.col("first.doc_id").alias("lo"), F.col("first.start").alias("start"), "hi").mapInPandas(lean(unchained), MEMBERS), "members")
    distinct = members.groupBy("anchor", "s1", "s2").agg(
        F.min(F.struct("lo", "start")).alias("first"), F.max("hi").alias("hi"), F.first("n").alias("n"), F.first("at").alias("at")
    )
    distinct = stored(distinct.select("anchor", "s1", "s2", "n", "at", "first.lo", "first.start", "hi"), "distinct")
    kinds = stored(distinct.groupBy("anchor").agg(F.count("*").alias("segs"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most"), "kinds")
    several = stored(distinct.join(kinds.where("segs > 1").select("anchor"), "anchor").select("anchor", "s1", "s2", "n", "at", "lo", "start"), "several")

    keyed = several.select("s1", "lo", "start").mapInPandas(
        lambda it: (pd.DataFrame({"key": place_key(p.s1.to_numpy(), p.lo.to_numpy(), p.start.to_numpy())}) for p in it), "key long"
    )
    wanted = fetched(docs, bloom(keyed, "key")).withColumnRenamed("doc_id", "lo")
    texts = wanted.join(several, ["anchor", "s1", "s2", "lo", "start"]).dropDuplicates(["anchor", "s1", "s2"])
    texts = stored(texts.select(F.col("anchor").alias("key"), "s1", "s2", "n", "at", "lo", "words"), "texts")
    place = ["anchor", "s1", "s2"]
    lone = distinct.join(kinds.where("segs = 1").select("anchor"), "anchor").where("lo < hi")
    answers = stored(
        minima(texts).withColumnRenamed("key", "anchor").select(*place, "least", F.lit(None).cast("long").alias("all"))
        .unionByName(lone.select(*place, F.lit(None).cast("array<long>").alias("least"), F.col("lo").alias("all"))),
        "answers",
    )
    told = members.select("c1", "c2", "rel", "n", *place).join(answers, place).groupBy("c1", "c2").agg(F.collect_list(F.struct("rel", "n", "least", "all")).alias("told"))
    # The copies of one chain are one key; both sides are plain exchanges, so a hot one is split by adaptive execution.
    each_window = "transform(filter(sequence(0, t.n - 1), i -> t.least[i] < doc_id), i -> struct(start + t.rel + i AS a, start + t.rel + i + 1 AS b))"
    alone = "CASE WHEN t.all < doc_id THEN array(struct(start + t.rel AS a, start + t.rel + t.n AS b)) ELSE filter(array(struct(start AS a, start AS b)), x -> false) END"
    ranges = F.expr(f"flatten(transform(told, t -> CASE WHEN t.all IS NULL THEN {each_window} ELSE {alone} END))")
    found = held.select("c1", "c2", "doc_id", "text_key", "start").join(stored(told, "told"), ["c1", "c2"]).select("doc_id", "text_key", ranges.alias("ranges")).where("size(ranges) > 0")
    return stored(found, "ranges").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def covered(n: int, ranges) -> np.ndarray:
    """Which of n words a removed window covers."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges:
        step[r["a"]] += 1
        step[min(n, r["b"] + WINDOW - 1)] -= 1
    return np.cumsum(step[:n]) > 0


def text_places(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return place_key(keys, ids, np.zeros(len(ids), np.int64))


def judged(docs: DataFrame, changed: DataFrame, tell: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """`tell` of every row of docs, with column ranges: null where the document surely keeps all words.

    A Bloom filter of the changed texts tells these apart, so only the others' texts are shuffled, to meet their ranges. Each
    task runs one Python worker: finding the rows and telling of them are one step on either side."""
    changed = stored(changed, "repeats")
    keyed = changed.select("doc_id", "text_key").mapInPandas(
        lambda it: (pd.DataFrame({"key": text_places(p.doc_id.to_numpy(np.int64), p.text_key.to_numpy(np.int64))}) for p in it), "key long"
    )
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(keyed, "key"))

    def marked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([text_key(text_bytes(t)) for t in pdf.text], np.int64)
        known = pdf.doc_id.notna().to_numpy()
        ids = pdf.doc_id.where(known, 0).to_numpy().astype(np.int64)
        return known & maybe(filter_.value, text_places(ids, keys)), keys

    @lean
    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield tell(pdf[~marked(pdf)[0]].assign(ranges=None))

    @lean
    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, keys = marked(pdf)
            yield pdf.assign(text_key_=keys)[found]

    found = docs.mapInPandas(others, StructType([*docs.schema.fields, StructField("text_key_", LongType())]))
    ranges = changed.select(F.col("doc_id").alias("doc_id_"), F.col("text_key").alias("other_key_"), "ranges")
    same = (F.col("doc_id") == F.col("doc_id_")) & (F.col("text_key_") == F.col("other_key_"))
    met = found.join(ranges, same, "left").select(*[found[c] for c in docs.columns], ranges["ranges"])
    return docs.mapInPandas(sure, schema).unionByName(met.mapInPandas(lean(lambda it: map(tell, it)), schema))


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select("doc_id", "text")

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, text, r in zip(pdf.doc_id, pdf.text, pdf.ranges, strict=True):
            words = text_bytes(text).split()
            n = len(words)
            if r is not None:
                words = [w for w, gone in zip(words, covered(n, r).tolist(), strict=True) if not gone]
            out.append((doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return judged(docs, repeats(docs), told, REPORT)


def strip(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the repeated words gone from text; one that keeps no word has an empty text.

    Words that go take the white space before them along; what is kept is otherwise unchanged."""
    columns, schema = docs.columns, docs.schema
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = []
        for text, r in zip(pdf.text, pdf.ranges, strict=True):
            if r is not None:
                at = [m.span() for m in word.finditer(text)]
                gone = covered(len(at), r).tolist()
                ends = [0, *[b for _, b in at]]
                text = "".join(text[ends[k] : ends[k + 1]] for k in range(len(at)) if not gone[k]) + text[ends[-1] :]
                if all(gone):
                    text = ""
            texts.append(text)
        return pdf.assign(text=texts)[columns]

    return judged(docs, repeats(docs.select("doc_id", "text")), cut, schema)
