"""Plain forms of the corpus operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def components(ids: list, linked: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text: str | None) -> int:
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8"), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs: list[tuple]) -> dict:
    prints = np.array([simhash(t) for _, t in docs], dtype=np.uint64)
    linked = []
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            linked.append((docs[i][0], docs[j][0]))
    group = components([d for d, _ in docs], linked)
    return {d: (f"{int(p):016x}", group[d]) for (d, _), p in zip(docs, prints)}


def repeats(docs: list[tuple], depth: int = 50) -> dict:
    first: dict[bytes, int] = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - depth + 1):
            w = data[i : i + depth]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - depth + 1):
            if first[data[i : i + depth]] < doc_id:
                gone[i : i + depth] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]) if data else b""
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(data)]).sum())
        out[doc_id] = (len(data), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_scores(docs: list[tuple]) -> tuple[dict, int]:
    tokens = {d: WORDS.findall((t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    counts = Counter(w for d, _ in docs if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, _ in docs:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d])
        out[d] = (held[d], len(tokens[d]), sum(counts[w] > 0 for w in tokens[d]), base)
    return out, n


def pair_scores(docs: list[tuple], discount: float) -> dict:
    tokens = {d: WORDS.findall((t or "").translate(LOWER)) + [None] for d, t in docs}
    train = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip([None] + tokens[d][:-1], tokens[d]))
    n, v = sum(counts.values()), len(counts)
    score = lambda u, w: math.log10((pairs[u, w] + discount * (counts[w] + 0.1) / (n + 0.1 * (v + 1))) / (counts[u] + discount))
    return {d: sum(score(u, w) for u, w in zip([None] + t[:-1], t)) for d, t in tokens.items()}


def near_vectors(rows: list[tuple], cosine: float = 0.95) -> dict:
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids = [i for i, _ in usable]
    linked, counts = [], Counter()
    if usable:
        x = np.array([v / np.linalg.norm(v) for _, v in usable])
        close = x @ x.T >= cosine
        np.fill_diagonal(close, False)
        for a, b in zip(*np.nonzero(close)):
            counts[ids[a]] += 1
            if a < b:
                linked.append((ids[a], ids[b]))
    group = components(ids, linked)
    return {i: (counts[i], group.get(i, i)) for i, _ in rows}
