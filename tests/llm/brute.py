"""Plain single-process versions of the contracts, to hold the operators against."""

import hashlib
import re
from collections import defaultdict

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contaminated(docs, items, window=10):
    """docs, items: lists of (id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def without_repeats(docs, window=50):
    """(doc_id, n_words, n_removed, kept_sha256); docs without null ids."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    split = [(doc, word.findall(text or "")) for doc, text in docs]
    first = {}
    for doc, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, words=3, tau=2):
    """(doc_id, fingerprint, component_id)."""
    prints = [(doc, fingerprint(text, words)) for doc, text in docs]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= tau:
                root[find(a)] = find(b)
    least = {}
    for doc, f in prints:
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return [(doc, f"{f:016x}", least.get(find(f))) for doc, f in prints]
