"""Quality classifier by co-training: a text-content view and a metadata view teach each other, then score together.

The content view sees how words look and repeat (hashed word endings and word shapes, repeats of the word before); the
metadata view sees the record and its layout (language, source, length, lines, shares of letters, digits and symbols).
Each view is a logistic regression fitted on a bounded sample of labelled rows. In each round both views score all
documents; the TAUGHT rows of each class of which a view is surest go, with the label it gives them, to the other view's
training set. At last both views are calibrated on labelled rows that were held out from fitting, their log-odds are
combined, and all documents are scored. A document is rejected under a score that at most LOST of the good held-out
documents have (and never over one half).

Null or empty texts have no words and are scored by what is left. Null languages and sources are values of their own.
Rows with a null id are scored too, but teach nothing. Labels that are null or not 0/1 are left out; of several labels of
one document the largest counts. With fewer than 20 labelled rows of either class there is nothing to hold out: nothing is
rejected and the score is the base rate. Equally sure rows are taken by id. Repeated rows each give a row and teach once.
Further columns are kept, whatever their names; those with the name of a new column are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BASE, SPACE, Words, batches, cut, mix64, table

#: Most labelled rows that the fit sees (about); rounds; rows of each class that a view labels in a round.
LABELLED, ROUNDS, TAUGHT = 6_000, 2, 200
#: A view labels only rows whose calibrated chance is this sure; share of good documents that may be lost.
SURE, LOST = 0.98, 0.002
#: Hashed features of the content view and of the categories in the metadata view.
ENDINGS, SHAPES, CATEGORIES = 256, 128, 32
PIECE = 1_000_000

KIND = np.full(256, 5, dtype=np.uint8)  # classes of bytes: lower, upper, digit, high, point, symbol
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A], KIND[0x80:] = 0, 1, 2, 3
KIND[[0x2E, 0x2C, 0x27, 0x2D, 0x3A, 0x3B]] = 4


def content_view(texts: list[bytes]) -> np.ndarray:
    """Shares of word endings, word shapes and repeated words (texts x features)."""
    w = Words(texts)
    n, doc = len(texts), w.doc
    count = np.diff(w.first)
    share = 1.0 / np.maximum(count, 1)
    raw = np.frombuffer(w.data, dtype=np.uint8)
    tail = np.zeros(len(w.hash), dtype=np.uint64)
    shape = np.zeros(len(w.hash), dtype=np.uint64)
    for back in (1, 2, 3):
        at = w.end - back
        there = at >= w.start
        tail = tail * BASE + np.where(there, raw[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
        shape = shape * np.uint64(7) + np.where(there, KIND[raw[at]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    shape = (shape * np.uint64(7) + KIND[raw[w.start]] + np.uint64(1)) * np.uint64(4) + np.minimum((w.end - w.start) // 6, 3).astype(np.uint64)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    parts = [
        np.bincount(doc * ENDINGS + (mix64(tail) % np.uint64(ENDINGS)).astype(np.int64), minlength=n * ENDINGS).reshape(n, ENDINGS) * share[:, None],
        np.bincount(doc * SHAPES + (mix64(shape) % np.uint64(SHAPES)).astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES) * share[:, None],
        (np.bincount(doc[same], minlength=n) * share)[:, None],
        (np.bincount(doc[order][fresh], minlength=n) * share)[:, None],
        np.log1p(count)[:, None],
    ]
    return np.sqrt(np.concatenate(parts, axis=1)).astype(np.float32)


def metadata_view(texts: list[bytes], langs: list, sources: list, sizes: list) -> np.ndarray:
    """Record and layout: hashed language and source, lengths, lines, and shares of the classes of bytes."""
    n = len(texts)
    out = np.zeros((n, CATEGORIES + 12), dtype=np.float32)
    for i, (t, lang, source, size) in enumerate(zip(texts, langs, sources, sizes, strict=True)):
        for name, value in (("lang", lang), ("source", source)):
            out[i, xxhash.xxh64_intdigest(f"{name}={value}") % CATEGORIES] += 1
        raw = np.frombuffer(t, dtype=np.uint8)
        many, lines = max(len(t), 1), t.count(b"\n") + 1
        kinds = np.bincount(KIND[raw], minlength=6) / many
        space = SPACE[raw].sum() / many
        out[i, CATEGORIES:] = (*np.sqrt(kinds), space, np.log1p(len(t)), np.log1p(size or 0), np.log(lines), np.log1p(len(t) / lines), kinds[1] / (kinds[0] + kinds[1] + 1e-9))
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, steps: int = 150) -> View:
    """Ridge logistic regression with classes of equal weight, by accelerated gradient steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    ridge = penalty / len(y)
    v = np.ones(z.shape[1], dtype=np.float32) / np.float32(np.sqrt(z.shape[1]))
    for _ in range(20):  # the largest curvature
        v = z.T @ (share * (z @ v))
        largest = np.linalg.norm(v)
        v /= max(largest, 1e-12)
    step = np.float32(1 / (0.25 * largest + 0.25 + ridge))
    ridge = np.float32(ridge)
    w = last = np.zeros(z.shape[1], dtype=np.float32)
    b = last_b = np.float32(0)
    for t in range(steps):
        push = np.float32(t / (t + 3))
        at, at_b = w + push * (w - last), b + push * (b - last_b)
        error = share * (logistic(z @ at + at_b) - y)
        last, last_b = w, b
        w, b = at - step * (z.T @ error + ridge * at), at_b - step * error.sum()
    return View(mean, scale, w, float(b))


def calibrated(odds: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and (last) bias that turn columns of log-odds into calibrated ones: a small ridge regression by Newton steps."""
    x = np.column_stack((odds, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    w[:-1] = 1.0 / (x.shape[1] - 1)
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    prior = w.copy()
    for _ in range(steps):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (w - prior))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    views: tuple[View, View] | None
    weights: np.ndarray
    own: tuple[np.ndarray, np.ndarray]
    threshold: float
    base: float

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances of good quality: by content, by metadata, by both."""
        if self.views is None:
            same = np.full(len(content), self.base)
            return same, same, same
        odds = [v.odds(x) for v, x in zip(self.views, (content, metadata), strict=True)]
        return *(logistic(c[0] * o + c[1]) for c, o in zip(self.own, odds, strict=True)), logistic(np.column_stack(odds) @ self.weights[:-1] + self.weights[-1])


Views = tuple[View, View]
Matrices = tuple[np.ndarray, np.ndarray]


def cotrained(labelled: Matrices, y: np.ndarray, teach: Callable[[Views, tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """Fit both views; every fifth labelled row is held out for calibration.

    ``teach`` gives for both views what the other one teaches it: the features of the rows that the calibrated views are
    surest of, and their labels.
    """
    base = float(y.mean()) if len(y) else 1.0
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return Model(None, np.zeros(3), (np.zeros(2), np.zeros(2)), 0.0, base)
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::5]] = True
    train = [(x[~held], y[~held]) for x in labelled]
    for turn in range(ROUNDS + 1):
        views = tuple(fit(*t) for t in train)
        own = tuple(calibrated(v.odds(x[held])[:, None], y[held]) for v, x in zip(views, labelled, strict=True))
        if turn < ROUNDS:
            train = [(np.concatenate((x, more)), np.concatenate((known, given))) for (x, known), (more, given) in zip(train, teach(views, own), strict=True)]
    both = np.column_stack([v.odds(x[held]) for v, x in zip(views, labelled, strict=True)])
    weights = calibrated(both, y[held])
    good = np.sort(logistic(both @ weights[:-1] + weights[-1])[y[held] == 1])
    return Model(views, weights, own, float(min(0.5, good[int(LOST * len(good))])), base)


def _features(texts: list[bytes], langs: list, sources: list, sizes: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for b, e in batches(texts, PIECE):
        yield b, e, content_view(texts[b:e]), metadata_view(texts[b:e], langs[b:e], sources[b:e], sizes[b:e])


def _columns(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"), *more)


def _read(batch: pa.RecordBatch) -> tuple[list[bytes], list, list, list]:
    return [t.as_py() or b"" for t in batch.column(0)], *(batch.column(i).to_pylist() for i in (1, 2, 3))


def surest(docs: DataFrame, views: Views, own: tuple[np.ndarray, np.ndarray], taught: tuple[set, set]) -> list[dict[int, int]]:
    """For both views the ids and labels that the other view teaches it, from all rows of ``docs``.

    Each task hands on its TAUGHT surest rows of each view and class; ``taught`` has the ids that a view knows already.
    """
    known = tuple(np.array(sorted(t), dtype=np.int64) for t in taught)
    shared = docs.sparkSession.sparkContext.broadcast((views, own, known))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, own, taught = shared.value
        best = {(i, c): (np.zeros(0), np.zeros(0, dtype=np.int64)) for i in (0, 1) for c in (0, 1)}
        for batch in rows:
            ids = batch.column(4).to_numpy()
            for b, e, *x in _features(*_read(batch)):
                for i in (0, 1):
                    chance = logistic(own[i][0] * views[i].odds(x[i]) + own[i][1])
                    fresh = ~np.isin(ids[b:e], taught[1 - i])
                    for c in (0, 1):
                        sure = chance if c else 1 - chance
                        mine = np.flatnonzero(fresh & (sure >= SURE))
                        s, n = np.concatenate((best[i, c][0], sure[mine])), np.concatenate((best[i, c][1], ids[b:e][mine]))
                        _, once = np.unique(n, return_index=True)
                        s, n = s[once], n[once]
                        top = np.lexsort((n, -s))[:TAUGHT]
                        best[i, c] = s[top], n[top]
        for (i, c), (s, n) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(n), pa.int32()), pa.array([c] * len(n), pa.int32()), pa.array(s), pa.array(n)], ["view", "class", "sure", "doc_id"])

    found = cut(_columns(docs.where("doc_id IS NOT NULL"), "doc_id").mapInArrow(run, "view int, class int, sure double, doc_id bigint"))
    out: list[dict[int, int]] = [{}, {}]
    for i in (0, 1):
        for c in (0, 1):
            best = found.where((F.col("view") == i) & (F.col("class") == c)).groupBy("doc_id").agg(F.max("sure").alias("sure"))
            out[1 - i] |= {r["doc_id"]: c for r in best.orderBy(F.desc("sure"), "doc_id").limit(TAUGHT).collect()}
    return out


def collected(rows: DataFrame) -> tuple[Matrices, list[int], np.ndarray]:
    """Features of a bounded number of rows (doc_id, y and the text's columns), one for each id: features, ids, y."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, y = batch.column(4), batch.column(5)
            for b, e, content, metadata in _features(*_read(batch)):
                yield pa.RecordBatch.from_arrays([ids.slice(b, e - b), y.slice(b, e - b), pa.array([x.tobytes() for x in content.astype(np.float16)], pa.binary()), pa.array([x.tobytes() for x in metadata], pa.binary())], ["doc_id", "y", "content", "metadata"])

    found = {r["doc_id"]: r for r in sorted(_columns(rows, "doc_id", "y").mapInArrow(run, "doc_id bigint, y double, content binary, metadata binary").collect(), key=lambda r: r["content"])}
    found = [found[i] for i in sorted(found)]
    matrix = lambda name, kind, width: np.array([np.frombuffer(r[name], dtype=kind) for r in found], dtype=np.float32).reshape(-1, width)
    return (matrix("content", np.float16, ENDINGS + SHAPES + 3), matrix("metadata", np.float32, CATEGORIES + 12)), [r["doc_id"] for r in found], np.array([r["y"] for r in found])


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model; a hash of the id chooses the labelled rows that it sees. ``labels`` has doc_id and quality (0 or 1)."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    share = min(1.0, LABELLED / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))
    # at most about LABELLED rows of two numbers are broadcast
    labelled, ids, y = collected(docs.join(F.broadcast(some), "doc_id"))
    taught = (set(ids), set(ids))

    def teach(views: Views, own: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        chosen = surest(docs, views, own, taught)
        wanted = sorted(set(chosen[0]) | set(chosen[1]))  # at most 4 * TAUGHT
        features, ids, _ = collected(docs.where(F.col("doc_id").isin(wanted)).withColumn("y", F.lit(None).cast("double"))) if wanted else (tuple(x[:0] for x in labelled), [], None)
        out = []
        for j in (0, 1):
            mine = [n for n, i in enumerate(ids) if i in chosen[j]]
            taught[j].update(chosen[j])
            out.append((features[j][mine], np.array([float(chosen[j][ids[n]]) for n in mine])))
        return out

    return cotrained(labelled, y, teach)


NEW = ("p_content", "p_metadata", "score", "accepted")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in one struct (row), and what the model says of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in rows:
            for b, e, content, metadata in _features(*_read(batch)):
                p = model.scores(content, metadata)
                new = [*map(pa.array, p), pa.array(p[2] >= model.threshold)]
                yield pa.RecordBatch.from_arrays([*batch.slice(b, e - b).columns, *new], [*batch.schema.names, *NEW])

    others = [c for c in docs.columns if c not in ("text", "lang", "source", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    kept = _columns(docs, rest.alias("rest"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = kept.mapInArrow(run, f"{schema}, p_content double, p_metadata double, score double, accepted boolean")
    row = F.struct(*[F.col(f"rest.`{c}`" if c in others else c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return out.select(row.alias("row"), *NEW)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add p_content, p_metadata, score and accepted to the rows of ``docs`` (doc_id, text, lang, source, n_chars, ...)."""
    return _scored(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in NEW], *NEW)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "p_content", "p_metadata", "score", "accepted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier accepts."""
    model = trained(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, model).where("accepted").select(*[F.col(f"row.`{c}`") for c in docs.columns])
