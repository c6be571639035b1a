"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def suffix_dedup(docs, length=100):
    """docs: (doc_id, text or None) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, sha(kept))
    return out


def substring_dedup(docs, window=35):
    words = [(d, WORD.findall((t or "").encode())) for d, t in docs]
    times = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = {}
    for doc_id, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), sha(kept))
    return out


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_dups(docs, k=4, percent=80):
    lower = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
    sets = {}
    for doc_id, text in docs:
        w = WORD.findall((text or "").encode().translate(lower))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    g, by = Groups(sets), {}
    pairs = set()
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for ds in by.values():
        pairs.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            g.link(a, b)
    return {d: (len(s), g.find(d), g.find(d) == d) for d, s in sets.items()}


def style_tree(pages, page_features, least=5, content=0.7):
    """pages: (host, html) -> {host: {path: importance}}, by counting over lists of the distinct pages."""
    distinct = {}
    for host, html in pages:
        found = page_features(html)
        if found and found[1]:
            distinct[host, found[0]] = found[1]

    def importance(of):
        out = {}
        for path, nodes in of.items():
            if len(nodes) >= least:
                parts = []
                for values in ([[shape] for shape, _ in nodes], [grams for _, grams in nodes]):
                    n = Counter(v for vs in values for v in vs)
                    parts.append(math.exp(-sum(math.log(n[v]) for vs in values for v in vs) / sum(map(len, values))))
                out[path] = (1 - content) * parts[0] + content * parts[1]
        return out

    every, own = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for (host, _), nodes in distinct.items():
        for path, shape, grams in nodes:
            every[path].append((shape, grams))
            own[host][path].append((shape, grams))
    shared = importance(every)
    out = {}
    for host, of in own.items():
        mine = importance(of)
        out[host] = {p: min(mine.get(p, 9.0), shared.get(p, 9.0)) for p in of if p in mine or p in shared}
    return out


def sketch_likeness(a, b):
    """Likeness of two fingerprints (levels parted by bars: level, digests, cells of a subtable, cells)."""
    levels = []
    for text in (a, b):
        found = {}
        for part in text.split("|"):
            level, n, third, cells = part.split(" ")
            cells = [(int(x[0]), int(x[1], 16), int(x[2], 16)) if x[0] else (0, 0, 0) for x in (c.split(":") for c in cells.split(","))]
            found[int(level)] = (int(n), int(third), cells)
        levels.append(found)
    level = max(min(x) for x in levels)
    if any(level not in x for x in levels):
        return 0.0
    (n, third_a, cells_a), (m, third_b, cells_b) = levels[0][level], levels[1][level]
    if n + m == 0:
        return 1.0

    def fold(cells, third, to):
        out = [(0, 0, 0)] * (3 * to)
        for i, (c, k, h) in enumerate(cells):
            at = i // third * to + i % third % to
            out[at] = (out[at][0] + c, out[at][1] ^ k, out[at][2] ^ h)
        return out

    def peel(cells, third):
        cells, out = list(cells), {}
        places = lambda k: [i * third + (k >> 21 * i & 2097151) % third for i in range(3)]
        while True:
            pure = {k: (c, h) for i, (c, k, h) in enumerate(cells) if abs(c) == 1 and k not in out and i in places(k)}
            if not pure:
                return out if all(c == (0, 0, 0) for c in cells) else None
            for k, (c, h) in pure.items():
                if (cells[places(k)[0]][0], k) and any(cells[p][:2] == (c, k) for p in places(k)):
                    out[k] = c
                    for p in places(k):
                        cells[p] = (cells[p][0] - c, cells[p][1] ^ k, cells[p][2] ^ h)

    own = peel(cells_a, third_a), peel(cells_b, third_b)
    assert None not in own and [len(x) for x in own] == [n, m]  # each gives its own digests back
    to = min(third_a, third_b)
    left = peel([(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]) for x, y in zip(fold(cells_a, third_a, to), fold(cells_b, third_b, to))], to)
    if left is not None:
        assert set(left) == set(own[0]) ^ set(own[1])
    return 1 - len(set(own[0]) ^ set(own[1])) / (n + m)


def earliest_deadlines(weight, blocks):
    """{(source, block): slot}: in each slot the released block with the earliest deadline, ties by source."""
    total, done, out, slot = sum(weight.values()), dict.fromkeys(weight, 0), {}, 0
    while any(done[s] < blocks[s] for s in done):
        ready = [(-(-(done[s] + 1) * total // weight[s]), s) for s in done if done[s] < blocks[s] and done[s] * total // weight[s] <= slot]
        if ready:
            s = min(ready)[1]
            out[s, done[s]] = slot
            done[s] += 1
        slot += 1
    return out
