"""License scans, lexical search and ball k-means beside plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ball_kmeans, license_scan
from corvane.llm.ball_kmeans import Balls

DOCS = "doc_id bigint, text string"


def plain_scan(text):
    """Every block of every template, by sets."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for label, t in license_scan.TEMPLATES:
        own = license_scan.words_of(t)
        for b in range(0, len(words), len(own)):
            both = len(set(own) & set(words[b : b + 2 * len(own)]))
            if both >= license_scan.needed(len(set(own)), license_scan.THRESHOLD):
                found.append((label, both / len(set(own))))
    base = sorted({label for _, label in places})
    labels = sorted(set(base) | {label for label, _ in found})
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), max((s for _, s in found), default=0.0)


def test_license_scan(spark):
    rng = random.Random(41)
    common = ["the", "of", "License", "copy", "and", "x1", "é", "İstanbul", "K", "under", "software", "this"]
    texts = [None, "", "  ", "MIT License", "mit license MIT-LICENSE mit\nlicense", "cc by cc by", "Kmit license", "GNU general  PUBLIC license cc  by-nc"]
    for _, t in license_scan.TEMPLATES:
        words = t.split()
        for gone in (0, 1, 2, 5):
            some = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), min(gone, len(words)))]
            texts.append(" ".join(rng.choices(common, k=rng.randrange(30)) + some + rng.choices(common, k=rng.randrange(30))))
        texts.append("\n".join(words) + "," + ",".join(reversed(words)))
    texts.append(" ".join(rng.choices(common, k=20000)) + " " + license_scan.TEMPLATES[1][1] + " end")
    texts += ["apache license " * 3000, "license " * 30000, texts[20], texts[20]]
    data = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, n_words int").repartition(3)
    got = sorted((tuple(r) for r in license_scan.scanned(df).collect()), key=repr)
    assert got == sorted(((i, *plain_scan(t)) for i, t, _ in data), key=repr)
    assert license_scan.scanned(df.limit(0)).count() == 0
    assert {r.labels for r in license_scan.scanned(df, templates=[], phrases=[]).collect()} == {""}
    assert any(r.labels and not r.base_labels for r in license_scan.scanned(df).collect())


def test_license_scan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "x")], DOCS)
    plan = license_scan.scanned(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_kmeans(rows, k=8, rounds=10):
    """Lloyd's rounds with whole searches."""
    kept = [(i, [max(-(2**26), min(2**26, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    put = lambda: [min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = put()
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = put()
    far = [dist(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    each = [sum(d for d, a in zip(far, at, strict=True) if a == j) for j in range(len(centroids))]
    return [(i, a, d, each[a], sum(far), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, d in zip(kept, at, far, strict=True)]


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, ball int"


def test_ball_kmeans(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64))
    data = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=64) * rng.choice([0.05, 0.6])]) for i in range(150)]
    data += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] + [1.0] * 63), (206, [math.inf] + [1.0] * 63), (None, [0.5] * 64), (207, [0.0] * 64), (208, [0.0] * 64), (209, [3e38] * 64), (7, data[3][1]), (7, data[3][1])]
    df = spark.createDataFrame([(*r, None, "x", 3) for r in data], VECTORS).repartition(4)
    got = [tuple(r)[:6] for r in ball_kmeans.clustered(df).collect()]
    assert sorted(got, key=repr) == sorted(plain_kmeans(data), key=repr)


def test_ball_kmeans_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ball_kmeans.clustered(empty).count() == 0
    few = [(i, [float(i % 2)] * 64) for i in range(5)]  # fewer vectors than clusters, ties and empty clusters
    df = spark.createDataFrame([(*r, None, "x", 3) for r in few], VECTORS)
    assert sorted(tuple(r)[:6] for r in ball_kmeans.clustered(df).collect()) == sorted(plain_kmeans(few))


def test_balls_compare_little_and_change_nothing():
    """Random balls: any filing gives the nearest centroid, and a good one computes few distances."""
    rng = np.random.default_rng(6)
    centroids = rng.integers(-3000, 3000, size=(8, 64))
    v = np.concatenate([c + rng.integers(-300, 300, size=(200, 64)) for c in centroids] + [(centroids[0] + centroids[1])[None] // 2])
    gap = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
    for filed in (gap.argmin(axis=1), rng.integers(0, 8, size=len(v))):
        own = np.sqrt(gap[np.arange(len(v)), filed])
        radii = [float(own[filed == j].max(initial=0)) + 1 for j in range(8)]
        for r in (radii, [math.inf] * 8):
            best, least, before, made = Balls(centroids, r).nearest(v, filed)
            assert (best == gap.argmin(axis=1)).all() and (least == gap.min(axis=1)).all() and (before == gap[np.arange(len(v)), filed]).all()
            if filed is not None and (filed == gap.argmin(axis=1)).all():
                assert made < 2 * len(v)


def plain_search(docs, items, k=10):
    """Every document's whole score."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    kept = [(i, terms(t)) for i, t in docs if i is not None and terms(t)]
    n_docs, n_terms = len(kept), sum(len(w) for _, w in kept)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, w in kept:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, own in asked.items():
        scores = []
        for i, w in kept:
            m = 10 + (90 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in own if t in df and t in w)
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [10**6, 40])
def test_impact_search(spark, monkeypatch, size):
    """One shard a task, and many small ones; several portions of items in the second run."""
    from corvane.llm import impact_search

    monkeypatch.setattr(impact_search, "POSTINGS", size)
    monkeypatch.setattr(impact_search, "DOCUMENTS", size)
    monkeypatch.setattr(impact_search, "ITEM_BYTES", 10**6 if size > 100 else 900)
    rng = random.Random(43)
    words = [f"w{i}" for i in range(300)] + ["É", "İx", "über"]
    some = lambda n: rng.choice([" ", "-", "\n", "_"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, some(rng.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(15)] + [(None, "w1 w2"), (600, None), (601, ""), (602, "!!"), (603, "w200 " * 5000), (7, docs[7][1]), (-5, docs[7][1])]
    items = [(i, some(rng.choice([1, 3, 30]))) for i in range(40)] + [(50, None), (51, "zzz"), (None, "w1"), (52, docs[7][1]), (53, ""), (54, "w1"), (54, "w9 w250"), (55, docs[3][1]), (55, docs[3][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, item_id string, score int").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, n int")
    assert sorted(map(tuple, impact_search.searched(d, q).collect())) == plain_search(docs, items)


def test_impact_search_of_empty_tables(spark):
    from corvane.llm import impact_search

    d, q = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert impact_search.searched(x, y).count() == 0


def test_impact_search_stops_early_and_is_whole():
    """Rare and frequent terms: the frequent ones' postings are skipped once the bounds prove the best; floors cut more."""
    from corvane.llm.impact_search import Shard, ranked, weight

    rng = np.random.default_rng(8)
    n, df = 20_000, [12, 15, 9000, 12_000, 15_000]
    terms = [np.sort(rng.choice(5, size=0)) for _ in range(n)]
    has = np.zeros((n, 5), dtype=bool)
    for t, f in enumerate(df):
        has[rng.choice(n if t > 1 else 40, size=f, replace=False), t] = True
    terms = [np.flatnonzero(row) for row in has]
    begin = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    tf, sizes = rng.integers(1, 4, size=begin[-1]), rng.integers(50, 60, size=n)
    shard = Shard(np.arange(n) * 3, sizes, begin, np.concatenate(terms), tf, n, int(sizes.sum()), 5)
    weights = np.array([weight(n, f) for f in df])
    whole = shard.completed(np.arange(n), weights)
    want = ranked(np.arange(n) * 3, whole, 10)
    for floor in (0, int(want[1][-1]), int(want[1][3])):
        ids, scores, done = shard.best(np.arange(5), weights, weights, 10, floor)
        keep = want[1] >= floor
        assert (ids == want[0][keep]).all() and (scores == want[1][keep]).all() and done < begin[-1] / 2
    assert shard.best(np.arange(5), weights, weights, 10, int(weights.sum()) * 10**6)[2] == 0
