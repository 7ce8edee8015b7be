"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def library_ids(texts) -> list[list[int]]:
    return [e.ids for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def windows(items, n: int = 10) -> dict[tuple[str, ...], set[str]]:
    """Windows of (item, text) rows with their items."""
    out: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        ws = words(text)
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            out.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    return out


def hits(text: str | None, known: dict[tuple[str, ...], set[str]]) -> tuple[int, set[int], set[str]]:
    """(words, positions hit, items) of a document."""
    ws, at, items = words(text), set(), set()
    for k in {len(w) for w in known}:
        for i in range(len(ws) - k + 1):
            if (own := known.get(tuple(ws[i : i + k]))) is not None:
                at |= set(range(i, i + k))
                items |= own
    return len(ws), at, items


def classes(texts: list[str | None], threshold: float, idf_buckets: int) -> list[int]:
    """For each text the least position of its class: components of all pairs whose weighted Jaccard similarity reaches the threshold."""
    import xxhash

    cut = [re.findall(r"\w+", t.lower()) if t else [] for t in texts]
    df = Counter(b for ws in cut for b in {xxhash.xxh64_intdigest(w) % idf_buckets for w in ws})
    idf = lambda w: 1 + np.log((len(texts) + 1) / (df[xxhash.xxh64_intdigest(w) % idf_buckets] + 1))
    sets: list[dict[tuple[str, ...], float]] = []
    for ws in cut:
        width = min(5, len(ws))
        count = Counter(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) if ws else {}
        sets.append({s: n * float(np.mean([idf(w) for w in s])) for s, n in count.items()})
    root = list(range(len(texts)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) > 0:
                low = sum(min(w, b[s]) for s, w in a.items() if s in b)
                if low >= threshold * (sum(a.values()) + sum(b.values()) - low):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]
