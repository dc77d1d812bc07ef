"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def topk(rows, k=5):
    vecs = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if usable(v)}
    ids, out = sorted(vecs), []
    m = np.array([vecs[i] for i in ids], dtype=np.int64)
    for q in ids:
        if q % 50 == 0:
            s = m @ np.array(vecs[q])
            best = sorted((-int(s[j]), i) for j, i in enumerate(ids) if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def vector_links(rows, least=0.93):
    """rows: (id, vector, label)."""
    fit = [(i, np.array(v, float), c) for i, v, c in rows if usable(v) and c is not None and np.any(v)]
    pairs = []
    for x in range(len(fit)):
        for y in range(x):
            (i, a, c), (j, b, d) = fit[x], fit[y]
            if c == d and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                pairs.append((i, j))
    n = Counter(i for p in pairs for i in p)
    up = roots([r[0] for r in rows], pairs)
    return sorted((i, n[i], up[i], i == up[i]) for i, _, _ in rows)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        out = {s: 3.0 * sizes[s] for s in stopped}
        for s in free:
            out[s] = left * weight[s] / sum(weight[f] for f in free)
        above = {s for s in free if out[s] > 3 * sizes[s]}
        if not above:
            return out
        stopped |= above


def shingles(text, n=5):
    w = word_list(lowered(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def shingle_classes(rows):
    """rows: (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    post = defaultdict(set)
    for x, (_, s) in enumerate(sets):
        for g in s:
            post[g].add(x)
    pairs = []
    for x, (i, s) in enumerate(sets):
        shared = Counter(y for g in s for y in post[g] if y < x)
        pairs += [(i, sets[y][0]) for y, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[y][1]) - n)]
    up = roots([i for i, _ in rows], pairs)
    return sorted((i, len(s), up[i]) for i, s in sets)


def substring_dedup(rows, width=20):
    first = {}
    docs = sorted(((i, word_list(t)) for i, t in rows), key=lambda r: r[0])
    for i, w in docs:
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def warc(rows):
    """rows: (id, html)."""
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def crc(i):
    return zlib.crc32(str(i).encode())


def unigram(rows):
    """rows: (id, text) -> (id, held_out, n_tokens, n_known, train_tokens, base_score); token None is the end."""
    docs = [(i, [*word_list(lowered(t)), None]) for i, t in rows]
    c = Counter(w for i, ws in docs if crc(i) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    out = []
    for i, ws in docs:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, crc(i) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, base))
    return sorted(out)
