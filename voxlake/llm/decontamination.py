"""Operator 3: benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) and cut into windows of 10 words. Each
distinct word of the benchmark gets a code of the same few characters, the automaton holds the coded windows, and a document
is scanned once as the string of its words' codes, where one other character stands for any word that no item has. First and
later characters of a code come from different alphabets, so every match starts and ends at words, and match ends map back to
words and from there to offsets in the original text.

The benchmark is broadcast, so its size is checked: beyond `BLOCK_WORDS` words it is cut into blocks, each with an automaton
of its own, and documents pass them one after another with the state kept in the shared folder between them.

Null and empty texts have no words; items with a null text or no words have no windows and never count; repeated items and
documents each count; item ids are compared as given. Items without an id hit like any other; all that hit a document count as
one in n_items, and items_sha256 leaves them out. Empty tables give empty results. Only id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import WORD_BYTES, bounded, lean, stored, text_bytes

WINDOW = 10
#: Words of benchmark text in one automaton; its nodes, about 20 a word, then take under 200 MB.
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.ASCII)
STATE = "doc_id long, n_words long, firsts array<int>, lasts array<int>, items array<string>"


def split(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(WORD_BYTES).split()


class Automaton:
    """Windows of test items; built in each Python worker from the normalised items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        import ahocorasick

        vocabulary = sorted({w for _, words in items for w in words})
        self.size = 1
        while 64**self.size < len(vocabulary):
            self.size += 1
        self.code = {}
        for n, w in enumerate(vocabulary):
            digits = [n >> 6 * k & 63 for k in range(self.size)]
            self.code[w] = chr(256 + digits[0]) + "".join(chr(512 + d) for d in digits[1:])
        windows: dict[str, tuple[int, set[str | None]]] = {}
        for item, words in items:
            n = min(window, len(words))
            for k in range(len(words) - n + 1 if words else 0):
                windows.setdefault("".join(map(self.code.get, words[k : k + n])), (n, set()))[1].add(item)
        self.machine = ahocorasick.Automaton()
        for key, value in windows.items():
            self.machine.add_word(key, value)
        if windows:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word ranges [first, last) of all occurring windows, joined where they touch, and the items these are from."""
        if not self.code or not words:
            return [], set()
        codes = [self.code.get(w, " ") for w in words]
        found = list(self.machine.iter("".join(codes)))
        if not found:
            return [], set()
        ends = np.cumsum([len(c) for c in codes])
        last = np.searchsorted(ends, [end + 1 for end, _ in found]) + 1
        spans, items = [], set()
        for first, stop, (_, ids) in sorted((int(b) - v[0], int(b), v) for b, (_, v) in zip(last, found, strict=True)):
            items |= ids
            if spans and first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
            else:
                spans.append((first, stop))
        return spans, items


def blocks(benchmark: DataFrame) -> list[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most BLOCK_WORDS words (a longer item has its own), read a partition at a time."""
    out: list[list] = [[]]
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    for r in rows.toLocalIterator():
        words = split(r.text)
        if size and size + len(words) > BLOCK_WORDS:
            out.append([])
            size = 0
        if words:
            out[-1].append((r.item_id, words))
            size += len(words)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    """Of every document: doc_id, n_words, its hit word ranges [firsts, lasts) and the items with occurring windows, sorted."""
    bounded(docs.sparkSession)
    state = docs.select("doc_id", "text")
    parts = blocks(benchmark)
    for number, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        keep = with_text or number < len(parts) - 1

        @lean
        def scan(batches: Iterator[pd.DataFrame], shared=shared, keep=keep) -> Iterator[pd.DataFrame]:
            automaton = Automaton(shared.value)
            for pdf in batches:
                counts, firsts, lasts, items = [], [], [], []
                old = zip(pdf.firsts, pdf.lasts, pdf["items"], strict=True) if "firsts" in pdf else [((), (), ())] * len(pdf)
                for text, (a, b, c) in zip(pdf.text, old, strict=True):
                    words = split(text)
                    spans, ids = automaton.scan(words)
                    spans = merge([*zip(a, b, strict=True), *spans]) if len(a) else spans
                    counts.append(len(words))
                    firsts.append([x for x, _ in spans])
                    lasts.append([x for _, x in spans])
                    items.append(sorted(ids.union(c), key=lambda x: (x is None, x or "")))
                out = pd.DataFrame({"doc_id": pdf.doc_id, "n_words": counts, "firsts": firsts, "lasts": lasts, "items": items})
                yield out.assign(text=pdf.text) if keep else out

        state = state.mapInPandas(scan, STATE + (", text string" if keep else ""))
        if number < len(parts) - 1:
            state = stored(state, "decontamination")
    return state


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, start, end, found) for every hit passage: character offsets in the original text, and the passage itself."""

    @lean
    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, firsts, lasts in zip(pdf.doc_id, pdf.text, pdf.firsts, pdf.lasts, strict=True):
                if len(firsts):
                    at = [m.span() for m in WORD.finditer(lower(text))]
                    out += [(doc, at[a][0], at[b - 1][1], text[at[a][0] : at[b - 1][1]]) for a, b in zip(firsts, lasts, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "found"])

    return occurrences(docs, benchmark, True).mapInPandas(located, "doc_id long, start long, end long, found string")


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return occurrences(docs, benchmark).selectExpr(
        "doc_id", "n_words", "cast(aggregate(lasts, 0L, (s, x) -> s + x) - aggregate(firsts, 0L, (s, x) -> s + x) AS long) AS n_hit",
        "cast(size(items) AS long) AS n_items", "sha2(array_join(items, ','), 256) AS items_sha256", "size(firsts) > 0 AS contaminated",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with no benchmark window in their text."""
    bounded(docs.sparkSession)
    out = docs
    parts = blocks(benchmark)
    for number, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        @lean
        def kept(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = Automaton(shared.value)
            for pdf in batches:
                yield pdf[[not automaton.scan(split(t))[0] for t in pdf.text]]

        out = out.mapInPandas(kept, docs.schema)
        if number < len(parts) - 1:
            out = stored(out, "decontamination")
    return out
