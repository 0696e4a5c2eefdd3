"""Plain versions of the operators for small inputs."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(ids, links):
    """Smallest id that each id reaches."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def quality(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n, chars = len(w), sum(map(len, w))
    symbols, dup, repeat = sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    bits = (n < 50) + 2 * (100 * repeat > 50 * n) + 4 * (10 * symbols > n) + 8 * (2 * dup > len(lines)) + 16 * (chars < 2 * n or chars > 12 * n)
    return n, chars, symbols, len(lines), dup, repeat, bits


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_groups(docs, radius=3):
    """docs: {id: text} to {id: (fingerprint, component)}."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    found = components(ids, links)
    return {i: (prints[i], found[i]) for i in ids}


def similar_lines(docs):
    """docs: {id: text} to {id: numbers of lines that an earlier line resembles}."""
    seen, out = [], {}
    for i in sorted(docs):
        out[i] = []
        for k, line in enumerate((docs[i] or "").split("\n")):
            w = words(line)
            if not w:
                continue
            s = frozenset(w)
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                out[i].append(k)
            seen.append(s)
    return out


def without_lines(text, gone):
    return None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def copies(docs):
    """docs: (id, text, source) rows to {id: copies in the mix}, by resharing until nothing exceeds its cap."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = {}
    for i, text, source in docs:
        rate = target[source] / sizes[source] if sizes[source] else 1.0
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[i] = int(rate) + (draw < rate - int(rate))
    return out, target


def best_fit(lengths, capacity):
    """Sequences that sequential best fit, longest first, needs."""
    gaps, count = [], 0
    for size in sorted(lengths, reverse=True):
        k = bisect_left(gaps, size)
        gap = capacity if k == len(gaps) else gaps.pop(k)
        count += gap == capacity
        if gap > size:
            gaps.insert(bisect_left(gaps, gap - size), gap - size)
    return count


def repeated_bytes(docs, span):
    """docs: list of bytes; per document a mask of the bytes in strings that start twice."""
    count = Counter(t[p : p + span] for t in docs for p in range(len(t) - span + 1))
    out = []
    for t in docs:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if count[t[p : p + span]] > 1:
                mask[p : p + span] = True
        out.append(mask)
    return out


def runs(mask):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
