"""Operator 9: SentencePiece encoding and decoding with Gumbel top-k segmentation sampling.

The lattice of a text has an edge for every vocabulary piece at every place; a character without a piece gets one edge to its
bytes. Since no piece reaches over the start of a word, the lattice is a chain of words; backward sums over the lattices of
the distinct words of a batch are vectors over all words of one size. They turn edge scores into exact conditional
probabilities, so a forward walk is an exact sample. A word of over `LONG` characters (unspaced text) has its backward sums carried from block to block in logarithms, and the choices at
all its places are made as vectors, a block at a time, before the walk follows them; a megabyte without a space takes seconds.

k distinct segmentations of a whole text are drawn without replacement by a perturbed best-first search: a node is a prefix
with all its continuations, its Gumbel-perturbed log-probability is that of its best leaf, known before the leaf is. Popping
the best node walks down to that leaf; at every place on the way the choices not taken stay behind as one node, with a Gumbel
value truncated at the popped one's. The (k+1)-th value is the threshold that gives each sample its inclusion score, the
probability to be among the k. All random numbers are functions of the row key, the number of the sample and the place in the
text, so results depend neither on batches nor on partitions.

The public model has merge ranks instead of probabilities; pieces get Zipf probabilities 1 / (rank + 1), normalised.

A null text is an empty one; an empty text has the one empty segmentation, inclusion 1. A text with fewer than k
segmentations gives all of them, inclusion 1. Repeated rows with one key get the same samples; a null key is key 0. An empty
table gives an empty result. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import bounded, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SPACE, OWN_SPACE, STOP, END = 0x2581, 0x110000, 0x110001, 10
#: Characters of text in one vector batch.
BATCH = 1 << 19
P, PLACE = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Lattices are made for words of these sizes together, about so many cells at once; words beyond the last are on their own.
SIZES = np.array([4, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 48])
LONG = int(SIZES[-1])
CELLS = 1 << 20
#: Places of a long word that share an offset, and that are looked at together.
STRIDE, BLOCK = 64, 1 << 14
#: Ready for a batch and the spaces before its texts; every worker of a pipeline keeps them.
_READY = BATCH + (1 << 12)
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_READY, P))])
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_READY, np.uint64(pow(0x100000001B3, -1, 1 << 64))))])
NONE, PREFIX = -1, -2


class Vocabulary:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        raw = [b""] * n
        byte_id, plain = {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(piece[1:-1], 16)] = i
                raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((i, piece))
                raw[i] = piece.replace("▁", " ").encode()
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.cumsum([0] + [len(x) for x in raw])
        self.byte_id = [byte_id[b] for b in range(256)]
        rank = {i: r for r, (i, _) in enumerate(plain, 1)}
        total = sum(1 / (r + 1) for r in range(1, n + 1))
        self.score = np.array([-np.log((rank.get(i, n) + 1) * total) for i in range(n)])
        self.byte_score = float(-np.log((n + 1) * total))
        if any("▁" in p.lstrip("▁") or "\n" in p for _, p in plain):
            raise ValueError("a piece reaches over the start of a word")
        self.longest = max(len(p) for _, p in plain)
        self.chance = np.exp(self.score)
        singles = {p for _, p in plain if len(p) == 1}
        if any(c not in singles for _, p in plain for c in p):
            raise ValueError("a character of a piece is no piece itself")
        #: By the hash of every piece its id, and PREFIX for what only begins pieces.
        known: dict[int, int] = {}
        for i, piece in plain:
            h = 0
            for k, c in enumerate(piece, 1):
                h = (h * int(P) + ord(c) + 1) & (1 << 64) - 1
                known[h] = i if k == len(piece) else known.get(h, PREFIX)
        self.keys = np.array(sorted(known), np.uint64)
        self.ids = np.array([known[k] for k in self.keys.tolist()], np.int32)
        # Each slot names the key that falls there; keys that share a slot are looked up by bisection.
        slots = self.slot(self.keys)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[slots] = np.arange(len(slots))
        self.first[np.bincount(slots, minlength=1 << 20) > 1] = -2
        #: The piece of every single character.
        self.single = np.full(STOP + 1, NONE, np.int32)
        for i, piece in plain:
            if len(piece) == 1:
                self.single[ord(piece)] = i

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, PREFIX if it only begins pieces, or NONE."""
        slot = self.slot(h)
        at = self.first.take(slot)
        out = np.where((at >= 0) & (self.keys.take(at, mode="wrap") == h), self.ids.take(at, mode="wrap"), NONE)
        crowd = np.flatnonzero(at == -2)
        if len(crowd):
            at = np.minimum(np.searchsorted(self.keys, h[crowd]), len(self.keys) - 1)
            out[crowd] = np.where(self.keys[at] == h[crowd], self.ids[at], NONE)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def codes(text: str | None) -> np.ndarray:
    """Code points with a leading space; spaces as the space mark, the mark itself as a code beyond Unicode."""
    if not text:
        return np.zeros(0, np.int32)
    own = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return np.where(own == SPACE, np.int32(OWN_SPACE), np.where(own == 32, np.int32(SPACE), own))


def code_bytes(code: int) -> bytes:
    return chr(SPACE if code == OWN_SPACE else code).encode("utf-8", "surrogatepass")


def salted(seed: np.ndarray, what: int) -> np.ndarray:
    return seed + np.uint64((what * 0xD1342543DE82EF95) & (1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit numbers, which are overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return x * 2.0**-53 + 2.0**-54


def noise(seed: np.ndarray, place: np.ndarray, what: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit seeds, places and a purpose."""
    return mixed(salted(seed, what) + place.astype(np.uint64) * PLACE)


def edges(chars: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces at all places of words that each end with `STOP`: (place, number there, length, id), id NONE for a bare character.

    All places grow at once, a character a step; a place is done with when no piece begins as it does."""
    live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    count = np.zeros(len(chars), np.int8)
    wide = np.concatenate([chars.astype(np.uint64) + np.uint64(1), np.zeros(v.longest, np.uint64)])
    out = []
    for k in range(v.longest):
        h = h * P + wide.take(live + k)
        entry = v.find(h) if k else v.single.take(chars)
        if not k:
            bare = np.flatnonzero((entry == NONE) & (chars != STOP))
            count[bare] = 1
            out.append((bare, np.zeros(len(bare), np.int8), np.ones(len(bare), np.int8), np.full(len(bare), NONE, np.int32)))
        ok = np.flatnonzero(entry != NONE)
        live, h, entry = live.take(ok), h.take(ok), entry.take(ok)
        hit = np.flatnonzero(entry != PREFIX)
        at = live.take(hit)
        number = count.take(at)
        count[at] = number + 1
        out.append((at, number, np.full(len(hit), k + 1, np.int8), entry.take(hit)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Words:
    """Lattices of words of up to n characters; words end at place n. Row place * words + word has the pieces there, by length:
    cumulative probabilities, lengths and ids; lengths of 0 fill it up."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, n: int, v: Vocabulary):
        m = len(start)
        self.n, self.m = n, m
        word = np.repeat(np.arange(m), length + 1)
        first = np.cumsum(length + 1) - (length + 1)
        step = np.arange(len(word)) - first.take(word)
        place, number, size, found = edges(np.where(step < length[word], text[np.minimum(start[word] + step, len(text) - 1)], STOP), v)
        row = ((n - length[word] + step) * m + word)[place]
        width = int(number.max()) + 1
        self.ids, self.sizes, mass = np.full((m * n, width), NONE, np.int32), np.zeros((m * n, width), np.int8), np.zeros((m * n, width))
        cell = row * width + number
        self.ids.ravel()[cell], self.sizes.ravel()[cell] = found, size
        # Every path takes a bare character by itself, so its score cancels out and counts as 1: no word of this size underflows.
        mass.ravel()[cell] = np.where(found == NONE, 1.0, v.chance.take(found, mode="wrap"))
        beta = np.zeros(m * (n + 1))
        beta[n * m :] = 1
        for i in range(n - 1, -1, -1):
            a, b = i * m, i * m + m
            mass[a:b] *= beta.take(np.arange(a, b)[:, None] + self.sizes[a:b] * np.int64(m))
            np.einsum("mw->m", mass[a:b], out=beta[a:b])
        for k in range(1, width):
            mass[:, k] += mass[:, k - 1]
        mass /= np.where(mass[:, -1:] > 0, mass[:, -1:], 1)
        self.cumulative = mass


def byte_count(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 128) + (codes >= 0x800) + ((codes >= 0x10000) & (codes != OWN_SPACE))


class LongWord:
    """The lattice of one long word. Backward sums are kept as logarithms, `STRIDE` places and the `longest` after them a row,
    each row less its own offset, so that differences keep their precision however long the word is."""

    def __init__(self, codes: np.ndarray, v: Vocabulary):
        self.codes, self.v = codes, v
        n, w = len(codes), v.longest
        strides = -(-n // STRIDE)
        self.lead = strides * STRIDE - n
        self.beta = np.full((strides, STRIDE + w), -np.inf)
        after = np.full(w, -np.inf)
        after[0] = 0
        t = np.empty(w)
        for c in range(strides - 1, -1, -1):
            first = c * STRIDE - self.lead
            if c == strides - 1 or first + STRIDE == low:
                low = max(0, first + STRIDE - BLOCK)
                score = self.scores(low, first + STRIDE)[0]
            local = self.beta[c]
            local[STRIDE:] = after
            for j in range(STRIDE - 1, max(-first, 0) - 1, -1):
                np.add(score[first + j - low], local[j + 1 : j + 1 + w], out=t)
                top = t.max()
                np.subtract(t, top, out=t)
                np.exp(t, out=t)
                local[j] = top + np.log(t.sum())
            after = local[:w] - local[max(-first, 0)]

    def scores(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-scores and ids of the pieces of each length at places a to b."""
        w, n = self.v.longest, len(self.codes)
        ids, score = np.full((b - a, w), NONE, np.int32), np.full((b - a, w), -np.inf)
        one = self.codes[a : b + w].astype(np.uint64) + np.uint64(1)
        h = np.zeros(b - a, np.uint64)
        for k in range(w):
            h = h[: min(b, n - k) - a]
            if not len(h):
                break
            h = h * P + one[k : k + len(h)]
            found = self.v.find(h)
            hit = np.flatnonzero(found >= 0)
            ids[hit, k], score[hit, k] = found[hit], self.v.score[found[hit]]
        bare = np.flatnonzero(ids[:, 0] == NONE)
        score[bare, 0] = self.v.byte_score * byte_count(self.codes[a + bare])
        return score, ids

    def rows(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative probabilities and ids of the pieces of each length at places a to b."""
        score, ids = self.scores(a, b)
        c, j = np.divmod(np.arange(a, b) + self.lead, STRIDE)
        p = np.exp(score + self.beta[c[:, None], j[:, None] + 1 + np.arange(self.v.longest)] - self.beta[c, j][:, None])
        running = np.cumsum(p, axis=1)
        return running / running[:, -1:], ids

    def path(self, seed: np.ndarray, shift: int, number: int, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The walk from a place to the end: (places, lengths, probabilities, ids); `shift` is the word's place in its text."""
        at, out = place, []
        while at < len(self.codes):
            a, b = at, min(at + BLOCK, len(self.codes))
            cum, ids = self.rows(a, b)
            pick = picked(cum, noise(seed, np.arange(a, b) + shift, number))
            step, seen = (pick + 1).tolist(), []
            while at < b:
                seen.append(at)
                at += step[at - a]
            seen = np.array(seen, np.int64)
            rows = seen - a
            out.append((seen, pick[rows] + 1, chance_of(cum[rows], pick[rows]), ids[rows, pick[rows]]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, np.zeros(0), np.zeros(0, np.int32))


def one_noise(seed: int, place: int, what: int) -> float:
    """`noise` of a single place."""
    m = (1 << 64) - 1
    x = seed + what * 0xD1342543DE82EF95 + place * int(PLACE) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return ((x ^ x >> 31) >> 11) * 2.0**-53 + 2.0**-54


def picked(cum: np.ndarray, r: np.ndarray) -> np.ndarray:
    passed = np.einsum("rw->r", (cum <= r[:, None]).view(np.int8))
    return np.minimum(passed, np.int8(cum.shape[1] - 1)).astype(np.int64)


def chance_of(cum: np.ndarray, pick: np.ndarray) -> np.ndarray:
    flat = np.arange(len(pick)) * cum.shape[1] + pick
    cum = cum.ravel()
    return cum[flat] - np.where(pick > 0, cum[np.maximum(flat - 1, 0)], 0)


class Batch:
    """Texts of a batch as one array of codes, its words, and their lattices."""

    def __init__(self, texts: list[str | None], v: Vocabulary):
        self.v = v
        each = [codes(t) for t in texts]
        self.bounds = np.cumsum([0] + [len(c) for c in each])
        self.text = np.concatenate([*each, np.zeros(0, np.int32)])
        n = len(self.text)
        begins = np.zeros(n + 1, bool)
        if n:
            mark = self.text == SPACE
            begins[1:n] = (mark[1:] & ~mark[:-1]) | (self.text[:-1] == END)
        begins[self.bounds] = True
        edges = np.flatnonzero(begins)
        self.start = edges[:-1] if n else np.zeros(0, np.int64)
        stop = edges[1:] if n else np.zeros(0, np.int64)
        self.length = stop - self.start
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        powers, inverse = (t[: n + 1] if n < len(t) else np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, t[1]))]) for t in (_POWERS, _INVERSE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * powers[:n])])
        short = np.flatnonzero(self.length <= LONG)
        h = (sums[stop[short]] - sums[self.start[short]]) * inverse[self.start[short]] * np.uint64(0x9E3779B97F4A7C15) + self.length[short].astype(np.uint64)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([np.ones(min(1, len(h)), bool), h[order[1:]] != h[order[:-1]]])
        first, kind = order[new], np.empty(len(h), np.int64)
        kind[order] = np.cumsum(new) - 1
        start, length = self.start[short[first]], self.length[short[first]]
        size = np.searchsorted(SIZES, length)
        shelf, row = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        self.shelves: list[Words] = []
        for g in np.unique(size).tolist():
            mine, n = np.flatnonzero(size == g), int(SIZES[g])
            most = max(1, CELLS // (n * min(n, 8)))
            for a in range(0, len(mine), most):
                part = mine[a : a + most]
                shelf[part], row[part] = len(self.shelves), np.arange(len(part))
                self.shelves.append(Words(self.text, start[part], length[part], n, v))
        #: Of each word its shelf (-1: long) and row.
        self.shelf, self.row = np.full(len(self.start), -1), np.zeros(len(self.start), np.int64)
        self.shelf[short], self.row[short] = shelf[kind], row[kind]
        #: Words in order of their lattices, so that these are read one after another.
        self.order = np.concatenate([short[order], np.flatnonzero(self.length > LONG)])
        self.long: dict[int, LongWord] = {}

    def long_word(self, k: int) -> LongWord:
        if k not in self.long:
            self.long[k] = LongWord(self.text[self.start[k] : self.start[k] + self.length[k]], self.v)
        return self.long[k]

    def walk(self, seed: np.ndarray, number: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An exact sample of every text, or of its words that start at or beyond a character of the batch.

        Per character: piece length (0 inside a piece), the probability of that length, the piece's id."""
        taken = np.zeros(len(self.text), np.int8)
        chance = np.ones(len(self.text))
        ids = np.full(len(self.text), NONE, np.int32)
        wanted = np.ones(len(self.start), bool) if after is None else self.start >= after[self.doc]
        shelf = np.where(wanted, self.shelf, -2)[self.order]
        salts = salted(seed, number) - self.bounds[:-1].astype(np.uint64) * PLACE
        for g, w in enumerate(self.shelves):
            live = self.order[shelf == g]
            at = self.start[live]
            row = (w.n - self.length[live]) * w.m + self.row[live]
            salt = salts[self.doc[live]]
            while len(at):
                pick = picked(w.cumulative.take(row, axis=0), mixed(salt + at.astype(np.uint64) * PLACE))
                cell = row * w.ids.shape[1] + pick
                step = w.sizes.ravel().take(cell).astype(np.int64)
                taken[at] = step
                cum = w.cumulative.ravel()
                chance[at] = cum.take(cell) - np.where(pick > 0, cum.take(cell - 1, mode="wrap"), 0)
                ids[at] = w.ids.ravel().take(cell)
                row, at = row + step * w.m, at + step
                more = np.flatnonzero(row < w.n * w.m)
                row, at, salt = row.take(more), at.take(more), salt.take(more)
        for k in self.order[shelf == -1].tolist():
            a, d = int(self.start[k]), int(self.doc[k])
            places, lengths, p, found = self.long_word(k).path(seed[d : d + 1], a - int(self.bounds[d]), number, 0)
            taken[a + places], chance[a + places], ids[a + places] = lengths, p, found
        return taken, chance, ids

    def word_at(self, character: int) -> int:
        return int(np.searchsorted(self.start, character, side="right") - 1)

    def branch(self, a: int, character: int, seed: np.ndarray, number: int, used: dict[int, float]) -> tuple[list, int]:
        """A walk from a character of the text that begins at `a` to the end of its word, the first length none of those used.

        The parts of a path (places, lengths, log-probabilities, ids), and the place after the word."""
        k = self.word_at(a + character)
        stop = int(self.start[k] + self.length[k]) - a
        long = self.long_word(k) if self.shelf[k] < 0 else None
        shift = int(self.start[k]) - a
        if long is None:
            w = self.shelves[self.shelf[k]]
            rows = (np.arange(character, stop) - stop + w.n) * w.m + int(self.row[k])
            cum, ids, sizes = w.cumulative[rows].tolist(), w.ids[rows].tolist(), w.sizes[rows].tolist()
        else:
            cum, ids = (x.tolist() for x in long.rows(character - shift, character - shift + 1))
            sizes = [range(1, len(cum[0]) + 1)]
        steps, at = [], character
        while True:
            row, size = cum[at - character], sizes[at - character]
            r = one_noise(int(seed[0]), at, number)
            if not steps:
                p = [0.0 if n in used else b - a for a, b, n in zip([0.0, *row], row, size, strict=False)]
                running = list(itertools.accumulate(p))
                pick = min(bisect.bisect_right(running, r * running[-1]), len(p) - 1)
            else:
                pick = min(bisect.bisect_right(row, r), len(row) - 1)
            steps.append((at, size[pick], math.log(row[pick] - (row[pick - 1] if pick else 0.0)), ids[at - character][pick]))
            at += size[pick]
            if at >= stop or long is not None:
                break
        parts = [np.array(x) for x in zip(*steps, strict=True)]
        if long is not None:
            places, lengths, chance, found = long.path(seed, shift, number, at - shift)
            parts = [np.concatenate([x, y]) for x, y in zip(parts, (places + shift, lengths, np.log(chance), found), strict=True)]
        return parts, stop


def truncated(phi: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values at locations phi, given that they are at most `bound`."""
    return phi - np.log(np.exp(phi - bound) - np.log(u))


class Search:
    """The best-first search of one text; a node is a choice left behind on a path."""

    def __init__(self, batch: Batch, a: int, seed: np.ndarray, path: tuple, top: float, values: np.ndarray, bare: bool):
        self.batch, self.a, self.seed, self.bare = batch, a, seed, bare
        self.found = [(float(path[2].sum()), top, path)]
        #: (perturbed values from a step on, path, that step, probabilities of the lengths already taken there)
        self.nodes = [[values, path, 0, {}]]
        self.threshold = -np.inf
        self.next: tuple | None = None

    def pop(self) -> None:
        """Sets the best node, or none where all segmentations are found."""
        values, path, first, gone = max(self.nodes, key=lambda n: n[0].max())
        s = int(values.argmax())
        self.threshold = float(values[s])
        self.next = (values, path, first, gone, s) if np.isfinite(self.threshold) else None

    def word_end(self) -> int:
        k = self.batch.word_at(self.a + int(self.next[1][0][self.next[4]]))
        return int(self.batch.start[k] + self.batch.length[k])

    def grow(self, walk: tuple) -> None:
        """Walks down from the node that `pop` chose; the words after the branching word come from a fresh walk."""
        values, path, first, gone, s = self.next
        number, value = len(self.found), self.threshold
        values[s - first] = -np.inf
        used = {**(gone if s == first else {}), int(path[1][s]): float(np.exp(path[2][s]))}
        mine, stop = self.batch.branch(self.a, int(path[0][s]), self.seed, 3000 + number, used)
        taken, chance, ids = walk
        tail = np.flatnonzero(taken[stop:]) + stop
        fresh = (tail, taken[tail], np.log(chance[tail]), ids[tail])
        path = tuple(np.concatenate([old[:s], new, last]) for old, new, last in zip(path, mine, fresh, strict=True))
        self.found.append((float(path[2].sum()), value, path))
        logs = path[2][s:]
        rest = 1 - np.exp(logs)
        rest[0] -= sum(used.values())
        phi = float(path[2][:s].sum()) + np.concatenate([[0.0], np.cumsum(logs)[:-1]])
        self.nodes.append([left_behind(phi, rest, value, noise(self.seed, path[0][s:], 2000 + number)), path, s, used])

    def result(self) -> list[tuple]:
        out = []
        for logp, value, path in self.found:
            inclusion = 1.0 if not np.isfinite(self.threshold) else float(-np.expm1(-np.exp(min(700.0, logp - self.threshold))))
            out.append((logp, value, inclusion, expanded(self.batch, self.a, path) if self.bare else path[3]))
        return out


def left_behind(phi: np.ndarray, rest: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Perturbed values of the nodes with prefix log-probability phi whose choices not taken have probability `rest`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = phi + np.log(np.where(rest > 1e-12, rest, 0))
        return np.where(np.isfinite(phi), truncated(phi, bound, u), -np.inf)


def sample_batch(texts: list[str | None], keys: list[int], k: int, v: Vocabulary) -> list[list[tuple]]:
    """Per text up to k samples (log-probability, perturbed value, inclusion, ids), in order of the perturbed values."""
    with np.errstate(over="ignore", divide="ignore"):
        batch = Batch(texts, v)
        seed = np.array([x & (1 << 64) - 1 for x in keys], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
        top = -np.log(-np.log(noise(seed, np.zeros(len(texts)), 1000)))
        # The first sample of every text, and what it leaves behind, for the whole batch.
        taken, chance, ids = batch.walk(seed, 0)
        at = np.flatnonzero(taken)
        logs = np.log(chance[at])
        cut = np.searchsorted(at, batch.bounds)
        doc = np.repeat(np.arange(len(texts)), np.diff(cut))
        # Sums in fixed point are exact, so they do not depend on where a text stands in its batch.
        fixed = np.rint(logs * 2.0**36).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(fixed)])
        before = (running[:-1] - running[cut[:-1]][doc]) * 2.0**-36
        place = at - batch.bounds[doc]
        values = left_behind(before, 1 - chance[at], top[doc], noise(seed[doc], place, 2000))
        # A character without a piece is on every path.
        bare = np.bincount(doc[ids[at] == NONE], minlength=len(texts)) > 0
        searches: list[Search | None] = []
        for d in range(len(texts)):
            x, y = int(cut[d]), int(cut[d + 1])
            path = (place[x:y], taken[at[x:y]], logs[x:y], ids[at[x:y]])
            searches.append(Search(batch, int(batch.bounds[d]), seed[d : d + 1], path, float(top[d]), values[x:y].copy(), bool(bare[d])) if y > x else None)
        for number in range(1, k + 1):
            open_ = [x for x in searches if x is not None and len(x.found) == number]
            for x in open_:
                x.pop()
            if number == k:
                break
            after = np.full(len(texts), len(batch.text) + 1)
            for d, x in enumerate(searches):
                if x is not None and len(x.found) == number and x.next is not None:
                    after[d] = x.word_end()
            walk = batch.walk(seed, number, after)
            for d, x in enumerate(searches):
                if x is not None and len(x.found) == number and x.next is not None:
                    a, b = int(batch.bounds[d]), int(batch.bounds[d + 1])
                    x.grow(tuple(part[a:b] for part in walk))
        return [[(0.0, float(top[d]), 1.0, np.zeros(0, np.int32))] if x is None else x.result() for d, x in enumerate(searches)]


def expanded(batch: Batch, a: int, path: tuple) -> np.ndarray:
    """Identifiers of a path, with the bytes of characters that have no piece."""
    ids = path[3]
    bare = np.flatnonzero(ids == NONE)
    if not len(bare):
        return ids
    raw = [code_bytes(c) for c in batch.text[a + path[0][bare]].tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[bare] = [len(x) for x in raw]
    out = np.repeat(ids, sizes)
    out[out == NONE] = np.array(batch.v.byte_id, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
    return out


def pieces_bytes(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces one after another, and where each piece ends."""
    size = (v.offset[ids + 1] - v.offset[ids]).astype(np.int32)
    stop = np.cumsum(size)
    at = np.repeat((v.offset[ids] - (stop - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return v.flat[at], stop


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of a segmentation."""
    return pieces_bytes(ids, v)[0].tobytes()[1:].decode("utf-8", "surrogatepass")


def round_trips(texts: list[str | None], found: list[list[tuple]], v: Vocabulary) -> list[list[bool]]:
    """Whether each segmentation of each text decodes to it, some ten thousand pieces at once."""
    out, begin, size = [], 0, 0
    for d, rows in enumerate(found):
        size += sum(len(r[3]) for r in rows)
        if size > 1 << 14 or d == len(found) - 1:
            part = found[begin : d + 1]
            flat, stop = pieces_bytes(np.concatenate([np.zeros(0, np.int32), *[r[3] for rows in part for r in rows]]).astype(np.int32), v)
            ends, a, k = np.concatenate([[0], stop]).tolist(), 0, 0
            for text, rows in zip(texts[begin : d + 1], part, strict=True):
                own, same = (" " + text).encode("utf-8", "surrogatepass") if text else b"", []
                for r in rows:
                    k += len(r[3])
                    same.append(flat[a : ends[k]].tobytes() == own)
                    a = ends[k]
                out.append(same)
            begin, size = d + 1, 0
    return out


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[int], list[str | None]]]:
    """(ids, keys, texts) in vector batches of about BATCH characters, whatever the size of the incoming ones."""
    ids, keys, texts, size = [], [], [], 0
    for pdf in batches:
        for doc, text in zip(pdf.doc_id.tolist(), pdf.text.tolist(), strict=True):
            n = len(text or "")
            if size and size + n > BATCH:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
            none = doc is None or doc != doc
            ids.append(None if none else int(doc))
            keys.append(0 if none else int(doc))
            texts.append(text)
            size += n
    if ids:
        yield ids, keys, texts


def samples(docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """(doc_id, sample, log_prob, perturbed, inclusion, ids), up to k rows for every document."""

    @lean
    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for docs, keys, texts in gathered(batches):
            out = [(docs[d], number, *row) for d, rows in enumerate(sample_batch(texts, keys, k, v)) for number, row in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "sample", "log_prob", "perturbed", "inclusion", "ids"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(drawn, "doc_id long, sample int, log_prob double, perturbed double, inclusion double, ids array<int>")


def decoded(segments: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, sample, text): decodes columns doc_id, sample and ids."""

    @lean
    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "sample": pdf["sample"], "text": [decode(x, v) for x in pdf.ids]})

    return segments.select("doc_id", "sample", "ids").mapInPandas(back, "doc_id long, sample int, text string")


def report(docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """Per sample its figures, the checksum of its identifiers, and whether decoding gives the text back."""

    @lean
    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for docs, keys, texts in gathered(batches):
            out = []
            found = sample_batch(texts, keys, k, v)
            for d, (rows, told) in enumerate(zip(found, round_trips(texts, found, v), strict=True)):
                for number, ((logp, value, inclusion, ids), same) in enumerate(zip(rows, told, strict=True), 1):
                    packed = ids.astype("<i4").tobytes()
                    out.append((docs[d], number, len(ids), logp, value, inclusion, hashlib.sha256(packed).hexdigest(), same))
            yield pd.DataFrame(out, columns=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_sha256", "round_trip"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(
        drawn, "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, round_trip boolean"
    ).select("doc_id", "sample", "n_pieces", F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), "inclusion", "ids_sha256", "round_trip")
