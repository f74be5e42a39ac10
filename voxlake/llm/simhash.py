"""Operator 8: SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most `tau` bits differ. The bits are grouped into partitions, correlated bits together,
and each partition gets its own threshold t, -1 (not probed) upwards, such that the sum of (t + 1) is tau + 1 or more: two
linked fingerprints then agree within t in at least one partition. Dynamic programming picks the thresholds with the least
estimated work, from bit counts and bit correlations of the whole corpus. Probing enumerates the values within half of t of
a partition's value on both sides, rows meet by (partition, value), and every candidate is verified on all bits.

For similarity thresholds rather than a number of bits (`keep_first`), a fingerprint is of the SET of shingles, each counted
once, and has further lanes of 64 bits. With `recall` the thresholds are allocated over the partitions of all lanes, such that
a pair at the least similarity is met in at least one partition with that probability, again at the least estimated work;
without it, the first lane must find all pairs within `tau` bits. The bits that differ in all lanes pick the pairs worth a
look, and every link is proven by the Jaccard similarity of the two sets of shingle hashes, which are made anew, in a second
pass, for the sets that have a candidate. Candidate links are proven along a spanning forest first. Only where a link of a
group fails are the other candidates of that group looked at, those between its proven pieces, in cells of bounded size.

Equal fingerprints are one node, so groups of copies cost one row each. Within a bucket only the edges of a spanning forest
leave the task, never all pairs. A bucket with more than `BUCKET` fingerprints is not compared as it is: its rows get new
keys, one for each of tau + 1 parts of the bits outside the partition (of the linked pairs that meet there, every one agrees
on one part), and go to other tasks; after `DEPTH` rounds what is left is compared block by block in bounded memory.

Null and empty texts have fingerprint zero and link like any other; rows with a null doc_id get their fingerprint's
component and never name one; repeated rows share a component. An empty table gives an empty result. Only doc_id and text
are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.bloom import bloom, maybe
from voxlake.llm.common import LOWER, bounded, lean, stored, text_bytes
from voxlake.llm.components import components

WORDS, TAU = 3, 2
BUCKET, DEPTH, BLOCK, LEADERS = 2000, 3, 1000, 16
SIMILARITY, CELL = 0.8, 500
#: Pairs of fingerprints that are compared in the time a row takes to be sent.
ROW_COST = 500.0
STEP = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of another lane of a wide fingerprint; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64(lane * STEP & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The hash of every shingle in order, repeats included; a shorter text is one shingle, one without words has none."""
    tokens = text_bytes(text).translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The bits of each lane: set where over half of the hashes have them."""
    counts = np.zeros((lanes, 64), np.int64)
    for k in range(0, len(hashes), 1 << 16):
        for lane in range(lanes):
            bits = np.unpackbits(mixed(hashes[k : k + (1 << 16)], lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, words: int = WORDS, lanes: int = 1, seed: int = 42) -> np.ndarray:
    """The majority bits of all shingles, repeats included."""
    return majority(shingles(text, words, seed), lanes)


def lane_names(lanes: int) -> list[str]:
    return ["fingerprint", *[f"lane{k}" for k in range(1, lanes)]]


def node_of(prints: np.ndarray) -> np.ndarray:
    """One number for each row of lanes; a fingerprint of one lane is its own."""
    out = prints[:, 0]
    for k in range(1, prints.shape[1]):
        out = mixed(out ^ prints[:, k], k)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, lanes: int = 1) -> DataFrame:
    """(doc_id, node, fingerprint, lane1, ...), all as signed longs."""
    names = lane_names(lanes)

    @lean
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = np.array([fingerprint(t, words, lanes) for t in pdf.text], np.uint64).reshape(-1, lanes)
            columns = dict(zip(names, np.ascontiguousarray(prints.T).view(np.int64), strict=True))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "node": node_of(np.ascontiguousarray(prints)), **columns})

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(made, "doc_id long, node long, " + ", ".join(f"{c} long" for c in names))


def row_key() -> dict[str, F.Column]:
    """What tells rows apart: no column is null, so that no id passes through floating point on its way to Python."""
    return {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "text_id": F.xxhash64("text")}


def set_fingerprints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """(no_id, id, text_id, node, set_id, fingerprint, lane1, ...): of the set of shingles."""
    names = lane_names(lanes)

    @lean
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingles(t, words)) for t in pdf.text]
            prints = np.array([majority(s, lanes) for s in sets], np.uint64).reshape(-1, lanes)
            columns = dict(zip(names, np.ascontiguousarray(prints.T).view(np.int64), strict=True))
            set_id = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"no_id": pdf.no_id, "id": pdf.id, "text_id": pdf.text_id, "node": node_of(np.ascontiguousarray(prints)), "set_id": set_id, **columns})

    bounded(docs.sparkSession)
    schema = "no_id boolean, id long, text_id long, node long, set_id long, " + ", ".join(f"{c} long" for c in names)
    return docs.select(*[c.alias(name) for name, c in row_key().items()], "text").mapInPandas(made, schema)


def set_hashes(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, hashes) of the sets (set_id, row), the sorted hashes of their shingles as bytes; `row` is the hash of a row's key.

    One row stands for a set, and a Bloom filter tells the others apart before their shingles are made."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "row"))

    @lean
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mine = pdf[maybe(filter_.value, pdf.row.to_numpy(np.int64))]
            for a in range(0, len(mine), 100):
                part = mine.iloc[a : a + 100]
                yield pd.DataFrame({"row": part.row, "hashes": [np.unique(shingles(t, words)).tobytes() for t in part.text]})

    rows = docs.select(F.xxhash64(*row_key().values()).alias("row"), "text").mapInPandas(made, "row long, hashes binary")
    return rows.join(wanted, "row").groupBy("set_id").agg(F.first("hashes").alias("hashes"))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    def values(self, prints: np.ndarray) -> np.ndarray:
        """Of rows of lanes; bit 64 * k + b is bit b of lane k."""
        out = np.zeros(len(prints), np.uint64)
        for k, b in enumerate(self.bits):
            out |= (prints[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)) << np.uint64(k)
        return out

    def masks(self) -> np.ndarray:
        """What to flip to reach every value within the radius."""
        reach = radius(self.threshold)
        flips = [sum(1 << k for k in c) for r in range(reach + 1) for c in combinations(range(len(self.bits)), r)]
        return np.array(flips, np.uint64)


def radius(threshold: int) -> int:
    """Both sides of a link probe, so each goes half of the way: two values within the threshold have one between them."""
    return (threshold + 1) // 2


def bit_statistics(prints: DataFrame, lanes: int = 1) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each lane how many have both bit i and bit j, over all of them."""
    names = lane_names(lanes)

    @lean
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((lanes, 64, 64))
        for pdf in batches:
            n += len(pdf)
            for k, f in enumerate(lanes_of(pdf, names).T):
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[k] += bits.T @ bits
        yield pd.DataFrame({"cell": np.arange(both.size + 1), "n": np.append(both.ravel(), n).astype(np.int64)})

    rows = prints.select(*names).mapInPandas(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(lanes * 4096 + 1)
    cells[rows.cell.to_numpy()] = rows.n.to_numpy()
    return int(cells[-1]), cells[:-1].reshape(lanes, 64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in groups of about equal size, the most correlated bits together."""
    p = np.diag(both) / max(1, n)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(deviation, deviation))
    free, out = set(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [max(free, key=lambda b: (sum(link[b][c] for c in free) - link[b][b], -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (sum(link[b][c] for c in group), -b))
            group.append(best)
            free.discard(best)
        out.append(tuple(sorted(group)))
    return out


def within(p: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    """Estimated probability that two fingerprints differ in at most 0, 1, 2, ... bits of a group."""
    chance = np.array([1.0])
    for d in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - d, d])
    eigen = np.maximum(np.linalg.eigvalsh(correlation), 0)
    effective = eigen.sum() ** 2 / max(1e-9, (eigen**2).sum()) / len(p)
    return np.cumsum(chance) ** effective


def correlations(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of set bits, and how bits go together, from the counts of one lane."""
    p = np.diag(both) / max(1, n)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = (both / max(1, n) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(link, 1)
    return p, link


def cheapest(n: int, groups: list[tuple[tuple[int, ...], np.ndarray]], worth: Callable[[int, int], int], need: int) -> tuple[float, list[Part]] | None:
    """Dynamic programming over the thresholds of groups of bits, each with its chances `within`: the least estimated work, rows
    sent plus pairs verified, for which the worths (of a size and a threshold) add up to `need`; none if nothing does."""
    least: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for bits, chance in groups:
        grown: dict[int, tuple[float, tuple | None]] = {}
        for t in (-1, 0, 2, 4):
            reach = radius(t)
            keys = 0 if t < 0 else sum(comb(len(bits), r) for r in range(reach + 1))
            work = 0.0 if t < 0 else ROW_COST * n * (keys + reach) + n * n / 2 * (chance[0] * keys + (chance[min(2 * reach, len(bits))] - chance[0]) * 2 * reach)
            unit = 0 if t < 0 else worth(len(bits), t)
            for used, (so_far, chosen) in least.items():
                total = min(need, used + unit)
                if total not in grown or so_far + work < grown[total][0]:
                    grown[total] = (so_far + work, (t, chosen))
        least = grown
    if need not in least:
        return None
    work, chosen = least[need]
    thresholds = []
    while chosen is not None:
        thresholds.append(chosen[0])
        chosen = chosen[1]
    return work, [Part(bits, t) for (bits, _), t in zip(groups, reversed(thresholds), strict=True)]


def allocate(n: int, both: np.ndarray, tau: int) -> list[Part]:
    """Partitions and thresholds that meet every pair within tau bits, over numbers of partitions the least estimated work."""
    p, link = correlations(n, both)
    best: tuple[float, list[Part]] | None = None
    for parts in range(1, tau + 2):
        groups = [(g, within(p[list(g)], link[np.ix_(g, g)])) for g in grouped_bits(n, both, parts)]
        found = cheapest(n, groups, lambda _, t: t + 1, tau + 1)
        if found and (best is None or found[0] < best[0]):
            best = found
    return best[1]


def allocate_wide(n: int, both: np.ndarray, similarity: float, recall: float) -> list[Part]:
    """Partitions of all lanes and thresholds that meet a pair of sets of this similarity at least with this probability.

    Sets of Jaccard similarity J have a cosine of 2J / (1 + J), and a bit differs with probability arccos(cosine) / pi. The worth
    of a threshold is the logarithm of the chance to miss, which adds up, in hundredths."""
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)

    def worth(size: int, t: int) -> int:
        caught = sum(comb(size, d) * differ**d * (1 - differ) ** (size - d) for d in range(min(t, size) + 1))
        return int(-100 * np.log(max(1e-9, 1 - caught)))

    need = int(np.ceil(-100 * np.log(1 - recall)))
    stats = [correlations(n, lane) for lane in both]
    best: tuple[float, list[Part]] | None = None
    for parts in range(2, 13):
        groups = []
        for k, (p, link) in enumerate(stats):
            groups += [(tuple(64 * k + b for b in g), within(p[list(g)], link[np.ix_(g, g)])) for g in grouped_bits(n, both[k], parts)]
        found = cheapest(n, groups, worth, need)
        if found and (best is None or found[0] < best[0]):
            best = found
    return best[1]


def lanes_of(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """The fingerprints of a batch, a row of lanes each."""
    return np.stack([pdf[c].to_numpy(np.int64).view(np.uint64) for c in names], axis=1)


def probes(nodes: DataFrame, parts: list[Part], lanes: int = 1) -> DataFrame:
    """(part, value, rest, fingerprint, lane1, ...): a row for each value that a fingerprint probes."""
    names = lane_names(lanes)

    @lean
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = lanes_of(pdf, names)
            for number, part in enumerate(parts):
                if part.threshold >= 0:
                    own, masks = part.values(f), part.masks()
                    for a in range(0, len(f), max(1, (1 << 18) // len(masks))):
                        b = a + max(1, (1 << 18) // len(masks))
                        value = (own[a:b, None] ^ masks[None, :]).ravel()
                        columns = {c: np.repeat(f[a:b, k], len(masks)).view(np.int64) for k, c in enumerate(names)}
                        yield pd.DataFrame({"part": np.int32(number), "value": value.view(np.int64), "rest": 0, **columns})

    return nodes.select(*names).mapInPandas(keyed, "part int, value long, rest long, " + ", ".join(f"{c} long" for c in names))


def near(a: np.ndarray, b: np.ndarray, tau: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the links between two blocks: at most tau bits of the first lane differ, and at most `most` of all."""
    i, j = np.nonzero(np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= tau)
    if most is not None and len(i):
        ok = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int32) <= most
        i, j = i[ok], j[ok]
    return i, j


def forest(f: np.ndarray, tau: int, most: int | None = None) -> list[np.ndarray]:
    """Edges (arrays of two columns, places in f) of a spanning forest of all links, compared block by block.

    In a large bucket whole components are grown from a few leaders first, each member against what is left only, so a group
    of near copies that fills the bucket costs little more than its size."""
    edges, rest = [], np.arange(len(f))
    for k in range(LEADERS):
        if len(rest) <= BLOCK:
            break
        at = int((k * 0.6180339887) % 1 * len(rest))
        front, rest = rest[at : at + 1], np.delete(rest, at)
        while len(front) and len(rest):
            found = np.full(len(rest), -1)
            for a in range(0, len(front), BLOCK):
                left = np.flatnonzero(found < 0)
                for b in range(0, len(left), BLOCK):
                    part = left[b : b + BLOCK]
                    i, j = near(f[front[a : a + BLOCK]], f[rest[part]], tau, most)
                    found[part[j]] = front[a : a + BLOCK][i]
            new = found >= 0
            edges.append(np.stack([found[new], rest[new]], axis=1))
            front, rest = rest[new], rest[~new]
    label = np.arange(len(rest))
    for a in range(0, len(rest), BLOCK):
        for b in range(a, len(rest), BLOCK):
            i, j = near(f[rest[a : a + BLOCK]], f[rest[b : b + BLOCK]], tau, most)
            i, j = i + a, j + b
            apart = i < j
            i, j = i[apart], j[apart]
            while len(i):
                high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
                apart = high != low
                i, j, high, low = i[apart], j[apart], high[apart], low[apart]
                if not len(i):
                    break
                _, once = np.unique(high, return_index=True)
                edges.append(np.stack([rest[i[once]], rest[j[once]]], axis=1))
                parent = np.arange(len(rest))
                parent[high[once]] = low[once]
                while not np.array_equal(parent, up := parent[parent]):
                    parent = up
                label = parent[label]
    return edges


def verify(keyed: DataFrame, tau: int, last: bool, lanes: int = 1, most: int | None = None) -> DataFrame:
    """Rows (a, b, part, value, rest): edges between nodes with part -1, and the rows of buckets that are too large."""
    names = lane_names(lanes)

    @lean
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        edges: list[np.ndarray] = []
        key, size, over = None, 0, False

        def closed() -> None:
            if size > 1 and not over:
                f = held[0] if len(held) == 1 else np.concatenate(held)
                if len(f) == 2:
                    x = np.bitwise_count(f[0] ^ f[1])
                    if x[0] <= tau and (most is None or int(x.sum(dtype=np.int32)) <= most):
                        edges.append(node_of(f)[None])
                elif len(f) > 2:
                    node = node_of(f)
                    edges.extend(node[e] for e in forest(f, tau, most))
            held.clear()

        def told() -> pd.DataFrame:
            e = np.concatenate(edges)
            edges.clear()
            return pd.DataFrame({"a": e[:, 0], "b": e[:, 1], "part": np.int32(-1), "value": 0, "rest": 0})

        for pdf in batches:
            f, columns = lanes_of(pdf, names), [pdf[c].to_numpy() for c in ("part", "value", "rest")]
            new = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))) if len(pdf) else []
            for a, b in zip(new, np.append(new[1:], len(pdf)), strict=True) if len(pdf) else ():
                mine = (columns[0][a], columns[1][a], columns[2][a])
                if mine != key:
                    closed()
                    key, size, over = mine, 0, False
                    if b - a == 1 and b < len(pdf):
                        size = 1  # alone in its bucket
                        continue
                held.append(f[a:b])
                size += b - a
                if size > BUCKET and not last:
                    over = True
                    rows = np.concatenate(held)[:, 0].view(np.int64)
                    yield pd.DataFrame({"a": rows, "b": rows, "part": np.int32(mine[0]), "value": mine[1], "rest": mine[2]})
                    held.clear()
            if edges:
                yield told()
        closed()
        if edges:
            yield told()

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "part", "value", "rest").sortWithinPartitions("part", "value", "rest")
    return dealt.mapInPandas(compared, "a long, b long, part int, value long, rest long")


def finer(rows: DataFrame, parts: list[Part], tau: int, depth: int) -> DataFrame:
    """New keys for the rows of large buckets: the old key, and one of tau + 1 parts of the bits outside the partition."""

    @lean
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf.a.to_numpy(np.int64).view(np.uint64)
            for number, part in enumerate(parts):
                mine = np.flatnonzero(pdf.part.to_numpy() == number)
                if len(mine):
                    others = np.random.default_rng(depth).permutation([b for b in range(64) if b not in part.bits])
                    for k, bits in enumerate(np.array_split(others, tau + 1)):
                        inner = Part(tuple(bits), 0).values(f[mine, None])
                        for v, old in ((inner, pdf.rest.to_numpy(np.int64)[mine].view(np.uint64)),):
                            mixed = (old * np.uint64(0x9E3779B97F4A7C15) + v * np.uint64(tau + 1) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
                            yield pd.DataFrame({"part": np.int32(number), "value": pdf.value.to_numpy()[mine], "rest": (mixed ^ mixed >> np.uint64(32)).view(np.int64), "fingerprint": f[mine].view(np.int64)})

    return rows.mapInPandas(keyed, "part int, value long, rest long, fingerprint long")


def links(nodes: DataFrame, tau: int = TAU, lanes: int = 1, most: int | None = None, least: float | None = None, recall: float | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all links among the distinct fingerprints.

    Wide fingerprints (several lanes) link at many differing bits, so parts of what is outside a partition would not tell
    them apart; their buckets are compared block by block at once."""
    n, both = bit_statistics(nodes, 1 if recall is None else lanes)
    parts = allocate(n, both[0], tau) if recall is None else allocate_wide(n, both, least, recall)
    edges, keyed, depths = None, probes(nodes, parts, lanes), 0 if lanes > 1 else DEPTH
    for depth in range(depths + 1):
        found = stored(verify(keyed, tau, depth == depths, lanes, most), "links")
        new = found.where("part < 0").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        large = found.where("part >= 0")
        if depth == depths or large.isEmpty():
            return edges
        keyed = finer(large, parts, tau, depth + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= least


def proven(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, root) with the column linked: whether the two sets are similar."""

    @lean
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            linked = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(pdf.x, pdf.y, strict=True)]
            yield pdf[["a", "b", "root"]].assign(linked=np.array(linked, bool))

    both = pairs.join(hashes.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(hashes.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "root", "x", "y").mapInPandas(compared, "a long, b long, root long, linked boolean")


def in_cells(rows: DataFrame) -> DataFrame:
    """The rows (root, piece, set_id, ...) dealt out so that any two of a root that are in different pieces meet in a cell.

    A piece of over `CELL` sets has groups of its own, which never meet each other; other pieces share groups."""
    large = rows.groupBy("root", "piece").count().where(F.col("count") > CELL).select("root", "piece", F.col("piece").alias("kind"))
    rows = rows.join(large, ["root", "piece"], "left")
    sizes = rows.groupBy("root", "kind").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    groups = sizes.select("root", F.col("kind").alias("other_kind"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("k"))
    name = lambda kind, k: F.concat_ws(":", F.coalesce(kind.cast("string"), F.lit("")), k.cast("string"))
    groups = groups.select("root", "other_kind", name(F.col("other_kind"), F.col("k")).alias("other"))
    sizes = sizes.select(F.col("root").alias("root_"), F.col("kind").alias("kind_"), "parts")
    rows = rows.join(sizes, (F.col("root") == F.col("root_")) & F.col("kind").eqNullSafe(F.col("kind_"))).drop("root_", "kind_")
    rows = rows.withColumn("own", name(F.col("kind"), F.pmod(F.xxhash64("set_id"), F.col("parts"))))
    apart = F.col("kind").isNull() | F.col("other_kind").isNull() | (F.col("kind") != F.col("other_kind"))
    met = rows.join(groups.withColumnRenamed("root", "root_"), (F.col("root") == F.col("root_")) & apart)
    return met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("root_", "kind", "other_kind", "other", "parts")


def cell_links(rows: DataFrame, tau: int, lanes: int, most: int | None, least: float) -> DataFrame:
    """(a, b): proven links between the pieces of each root, of all candidates there those that a spanning forest needs."""
    names, key = lane_names(lanes), ["root", "lo", "hi"]

    def linked(cell: pd.DataFrame) -> list[tuple[int, int]]:
        f, ids, own = lanes_of(cell, names), cell.set_id.to_numpy(), pd.factorize(cell.own)[0]
        sets, out = [np.frombuffer(h, np.uint64) for h in cell.hashes], []
        label = pd.factorize(cell.piece)[0]
        for a in range(0, len(f), BLOCK):
            for b in range(a, len(f), BLOCK):
                i, j = near(f[a : a + BLOCK], f[b : b + BLOCK], tau, most)
                i, j = i + a, j + b
                wanted = (i < j) & (label[i] != label[j]) & ((own[i] != own[j]) | (cell.lo.iat[0] == cell.hi.iat[0]))
                for x, y in zip(i[wanted].tolist(), j[wanted].tolist(), strict=True):
                    if label[x] != label[y] and similar(sets[x], sets[y], least):
                        label[label == label[y]] = label[x]
                        out.append((ids[x], ids[y]))
        return out

    @lean
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            cells = [c for _, c in pdf.groupby(key, sort=False)]
            for cell in cells:
                if held and tuple(held[0][key].iloc[0]) != tuple(cell[key].iloc[0]):
                    yield pd.DataFrame(linked(pd.concat(held, ignore_index=True)), columns=["a", "b"], dtype=np.int64)
                    held = []
                held.append(cell)
        if held:
            yield pd.DataFrame(linked(pd.concat(held, ignore_index=True)), columns=["a", "b"], dtype=np.int64)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_cells(rows).repartition(n, *key).sortWithinPartitions(*key).mapInPandas(compared, "a long, b long")


def set_links(docs: DataFrame, words: int, prints: DataFrame, tau: int, lanes: int, most: int | None, least: float, recall: float | None) -> DataFrame:
    """(a, b): proven links of sets, whose components are those of all candidate pairs that are similar enough."""
    names = lane_names(lanes)
    nodes = stored(prints.select("node", *names).distinct(), "nodes")
    found = links(nodes, tau, lanes, most, least, recall).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    found = stored(found, "candidates")
    roots = components(found).withColumnRenamed("a", "node")
    sets = stored(prints.select("set_id", "node", *names).distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sets")
    # One set stands for all of a fingerprint; the others of that fingerprint are candidates to it.
    first = sets.groupBy("node", "root").agg(F.min("set_id").alias("rep"))
    pairs = found.join(first.select(F.col("node").alias("a"), F.col("rep").alias("ra"), "root"), "a").join(first.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    pairs = pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "root")
    same = sets.join(first.select("node", "rep"), "node").where("set_id <> rep").select(F.col("set_id").alias("a"), F.col("rep").alias("b"), "root")
    pairs = stored(pairs.unionByName(same), "pairs")
    needed = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = prints.join(needed, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct(*row_key())).alias("key")).select("set_id", F.xxhash64("key.*").alias("row"))
    hashes = stored(set_hashes(docs, stored(wanted, "wanted"), words), "hashes")
    told = stored(proven(pairs, hashes, least), "proven")
    edges, doubtful = told.where("linked").select("a", "b"), told.where("NOT linked").select("root").distinct()
    pieces = components(edges).select(F.col("a").alias("set_id"), F.col("root").alias("piece"))
    rows = sets.join(doubtful, "root", "left_semi").join(pieces, "set_id", "left").withColumn("piece", F.coalesce("piece", "set_id"))
    return edges.unionByName(stored(cell_links(rows.join(hashes, "set_id"), tau, lanes, most, least), "links"))


def grouped(docs: DataFrame, words: int = WORDS, tau: int = TAU, lanes: int = 1, most: int | None = None) -> DataFrame:
    """(doc_id, fingerprint as a signed long, component_id) of every row."""
    prints = stored(fingerprints(docs, words, lanes), "fingerprints")
    nodes = stored(prints.groupBy("node", *lane_names(lanes)).agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, tau, lanes, most)).withColumnRenamed("a", "node")
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    least = named.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.min("first").alias("least"))
    labels = named.join(least, "root", "left").select("node", F.least("first", "least").alias("component_id"))
    return prints.join(labels, "node").select("doc_id", "fingerprint", "component_id")


def grouped_sets(docs: DataFrame, words: int, tau: int, lanes: int, most: int | None, least: float, recall: float | None = None) -> DataFrame:
    """(no_id, id, text_id, root) of every row: rows with one root are a group by proven links between their sets of shingles."""
    prints = stored(set_fingerprints(docs, words, lanes), "fingerprints")
    roots = components(set_links(docs, words, prints, tau, lanes, most, least, recall)).withColumnRenamed("a", "set_id")
    return prints.select("no_id", "id", "text_id", "set_id").join(roots, "set_id", "left").select("no_id", "id", "text_id", F.coalesce("root", "set_id").alias("root"))


def report(docs: DataFrame, words: int = WORDS, tau: int = TAU) -> DataFrame:
    return grouped(docs, words, tau).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, tau: int = TAU, lanes: int = 1, most: int | None = None, least: float = SIMILARITY, recall: float | None = None) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: the smallest id, then the least hash of the text.

    Rows are told apart by id and text, so different groups under one id each keep a row; rows without an id come last in
    their group, and a group of such rows only keeps one of them."""
    groups = grouped_sets(docs, words, tau, lanes, most, least, recall)
    first = groups.groupBy("root").agg(F.min(F.struct("no_id", "id", "text_id")).alias("first")).select("first.*")
    keys = [c.alias(f"{name}_") for name, c in row_key().items()]
    same = [F.col(f"{name}_") == F.col(name) for name in row_key()]
    kept = docs.select("*", *keys).join(first, same, "left_semi").dropDuplicates([f"{name}_" for name in row_key()])
    return kept.select(docs.columns)
