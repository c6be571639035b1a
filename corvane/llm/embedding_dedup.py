"""Embedding near-dedup with an inverted multi-index: product cells of two codebooks, multi-sequence search, exact check.

Vectors are cut into halves, each with a codebook of its own, so that k centroids a half make k * k cells. A vector lies
in the cell of its nearest centroids. For its search the squared distances to the borders of all other centroids' cells
are sorted for each half, and a queue gives the cells in the order of the summed distances (multi-sequence traversal) until
a limit. The limit is measured: for a bounded set of queries all partners among all rows are found by brute force, and it
is the least sum within which the target recall of these lies. (Without any such partner it is the one that vectors with
differences in all directions alike would need; no partner lies beyond 2 - 2 * threshold.) Whatever is found is checked by
its cosine in doubles.

Equal vectors of one label are one class with a weight, so copies are not compared with each other. Large cells are cut
into blocks; each pair of blocks is one task, which returns counts and a spanning forest, not pairs.

Vectors that are null or zero or hold null or non-finite components, and those with a null label, link with nothing.
Vectors of different lengths are not compared; those of another than the most common length share one cell for each
label. Rows with a null id are left out; repeated ids each give a row and count as vectors of their own. Further columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import components, cut, table

#: Vectors (at most about so many) on which the codebooks are fitted; all vectors are indexed. Queries (at most about so
#: many) whose partners among all vectors give the limit of the search, and steps of that limit.
SAMPLE, QUERIES, STEPS = 16_384, 512, 1000
#: Members of a label that a cell should hold; most centroids of a half; rows of a block.
PER_CELL, MOST, BLOCK = 64, 256, 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in doubles (by the largest component first, so nothing over- or underflows)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of a bounded sample; the start is evenly spaced along the first principal direction."""
    if len(points) == 0:
        return np.zeros((1, points.shape[1]))
    centred = points - points.mean(axis=0)
    along = centred @ np.linalg.svd(centred[:2048], full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    k = min(k, len(points))
    centroids = points[order[(np.arange(k) * len(points) + len(points) // 2) // k]].copy()
    for _ in range(rounds):
        near = nearest(points, centroids)[1]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centroids, axis=0)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (points * points).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T
    return d, d.argmin(axis=1)


def borders(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each point to the border between its own centroid's cell and every other; own centroid."""
    d, own = nearest(points, centroids)
    apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(apart > 0, (d - d[np.arange(len(d)), own][:, None]) / (2 * apart), 0.0)
    return np.maximum(away, 0.0) ** 2, own


def visited(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[int]:
    """The cells (i * len(second) + j) in the order of first[i] + second[j], up to the limit: a queue over both sequences."""
    i, j = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[i].tolist(), second[j].tolist()
    queue = [(a[0] + b[0], 0, 0)]
    while queue and queue[0][0] <= limit:
        _, x, y = heapq.heappop(queue)
        yield i[x] * len(b) + j[y]
        if y + 1 < len(b):
            heapq.heappush(queue, (a[x] + b[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(a):
            heapq.heappush(queue, (a[x + 1] + b[0], x + 1, 0))


def measured_limit(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dimension: int, threshold: float, recall: float, n: int) -> float | None:
    """The summed distance up to which a search finds the share ``recall`` of the links of a bounded set of queries."""
    half, most = dimension // 2, 2 - 2 * threshold
    usual = classes.where(F.size("embedding") == dimension)
    drawn = usual.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, QUERIES / max(1, n)))).select("rep", "label", "embedding").collect()
    if not drawn:
        return None
    q = unit(np.array([r["embedding"] for r in drawn], dtype=np.float64))
    (a, own1), (b, own2) = borders(q[:, :half], books[0]), borders(q[:, half:], books[1])
    ids, labels, cells = np.array([r["rep"] for r in drawn]), [r["label"] for r in drawn], own1 * len(books[1]) + own2
    of_label = {x: np.array([i for i, y in enumerate(labels) if y == x]) for x in set(labels)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in rows:
            found = batch.column("label").to_pylist()
            for label in set(found) & set(of_label):
                mine = [i for i, x in enumerate(found) if x == label]
                some, reps = batch.take(pa.array(mine)), batch.column("rep").to_numpy()[mine]
                v = unit(np.array(some.column("embedding").to_pylist(), dtype=np.float64))
                (c, at1), (d, at2) = borders(v[:, :half], books[0]), borders(v[:, half:], books[1])
                who = of_label[label]
                x, y = np.nonzero(q[who] @ v.T >= threshold)
                x, cell = who[x], at1[y] * len(books[1]) + at2[y]
                # the one in the cell with the smaller number searches
                own = a[x, at1[y]] + b[x, at2[y]]
                other = c[y, own1[x]] + d[y, own2[x]]
                need = np.where(cells[x] <= cell, own, other)[ids[x] != reps[y]]
                np.add.at(count, np.minimum(np.ceil(need / most * STEPS).astype(np.int64), STEPS), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(count)], ["step", "n"])

    steps = usual.select("label", "rep", "embedding").mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n"))
    count = np.zeros(STEPS + 1)
    for r in steps.collect():
        count[r["step"]] = r["n"]
    total = count.sum()
    return float(np.searchsorted(np.cumsum(count), recall * total)) / STEPS * most if total else None


def assigned(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dimension: int, limit: float) -> DataFrame:
    """Add ``cell`` and ``probes`` (the cells to search; of two cells only the one with the larger number is searched)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = dimension // 2
        for batch in rows:
            vectors = batch.column("embedding").to_pylist()
            cell, probes = [0] * len(vectors), [[0]] * len(vectors)
            usual = [i for i, v in enumerate(vectors) if len(v) == dimension]
            for lo in range(0, len(usual), 1024):
                some = usual[lo : lo + 1024]
                v = unit(np.array([vectors[i] for i in some]))
                (a, own1), (b, own2) = borders(v[:, :half], books[0]), borders(v[:, half:], books[1])
                own = own1 * len(books[1]) + own2
                for x, (i, c) in enumerate(zip(some, own.tolist(), strict=True)):
                    cell[i], probes[i] = c, [n for n in visited(a[x], b[x], limit) if n >= c]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), batch.column("w"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(probes, pa.list_(pa.int32()))], ["label", "rep", "w", "embedding", "cell", "probes"])

    element = classes.schema["embedding"].dataType.simpleString()
    return classes.select("label", "rep", "w", "embedding").mapInArrow(run, f"label {classes.schema['label'].dataType.simpleString()}, rep bigint, w bigint, embedding {element}, cell int, probes array<int>")


def compared(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        probe = rows.column("probe").to_numpy(zero_copy_only=False)
        ids, weight = rows.column("rep").to_numpy(), rows.column("w").to_numpy()
        inside = rows.column("inside").to_numpy(zero_copy_only=False)
        vectors = unit(np.array(rows.column("embedding").to_pylist(), dtype=np.float64)) if len(rows) else np.zeros((0, 1))
        q, m = np.flatnonzero(probe), np.flatnonzero(~probe)
        a, b = np.nonzero(vectors[q] @ vectors[m].T >= threshold)
        a, b = q[a], m[b]
        keep = ~inside[a] | (ids[a] < ids[b])  # in a probe's own cell each pair is seen from both sides
        a, b = a[keep], b[keep]
        nodes, at = np.unique(np.concatenate((ids[a], ids[b])), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        links, root = np.zeros(len(nodes), dtype=np.int64), nodes.copy()
        np.add.at(links, x, weight[b])
        np.add.at(links, y, weight[a])
        while True:
            before = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            if (before == root).all():
                break
        return pa.table({"rep": pa.array(nodes, pa.int64()), "links": pa.array(links), "root": pa.array(root, pa.int64())})

    return run


def linked(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    ``recall`` is the share of links that the search aims at, measured on a bounded set of queries; 1 visits all cells that
    can hold a partner.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint"), "embedding", "label")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # adding zero makes equal vectors equal in their bytes
    plus = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    keyed = vectors.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.xxhash64("label", plus)).alias("h1"), F.when(usable, F.xxhash64(plus, "label", F.lit(1))).alias("h2"), F.when(usable, F.col("embedding")).alias("embedding"))
    classes = cut(keyed.where("label IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding")))
    about = classes.groupBy("label", F.size("embedding").alias("d")).count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n"), "d").first()
    dimension, n = (about["d"], about["n"]) if about else (2, 0)
    drawn = classes.where(F.size("embedding") == dimension).sample(min(1.0, SAMPLE / max(1, n)), seed=5).select("embedding").collect() if n else []
    points = unit(np.array([r["embedding"] for r in drawn], dtype=np.float64)) if drawn else np.zeros((0, dimension))
    k = int(min(MOST, max(1, round(math.sqrt((about["most"] if about else 0) / PER_CELL)))))
    half = dimension // 2
    books = (codebook(points[:, :half], k), codebook(points[:, half:], k)) if half else (np.zeros((1, 0)), np.zeros((1, dimension - half)))
    limit = 2 - 2 * threshold
    if recall < 1 and half:
        # a margin for what the queries don't show; without links, two directions (one for each half): a Rayleigh tail
        aim = 1 - (1 - recall) / 2
        found = measured_limit(classes, books, dimension, threshold, aim, n)
        limit = min(limit, limit / dimension * -2 * math.log(1 - aim) if found is None else found)
    rows = cut(assigned(classes, books, dimension, limit).withColumn("d", F.size("embedding")))
    keys = ["label", "d", "cell"]
    probes = rows.select("label", "d", F.col("cell").alias("home"), "rep", "w", "embedding", F.explode("probes").alias("cell"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    counts = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("n_m")).join(probes.groupBy(keys).agg(F.count(F.lit(1)).alias("n_p")), keys).select(*keys, blocks("n_m").alias("b_m"), blocks("n_p").alias("b_p"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.join(counts, keys).select(*keys, own("b_m").alias("m"), every("b_p").alias("p"), F.lit(False).alias("probe"), F.lit(True).alias("inside"), "rep", "w", "embedding")
    asked = probes.join(counts, keys).select(*keys, every("b_m").alias("m"), own("b_p").alias("p"), F.lit(True).alias("probe"), (F.col("home") == F.col("cell")).alias("inside"), "rep", "w", "embedding")
    # the joins have dealt rows by the cell alone; the blocks of a large one are to be spread over tasks
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut(members.union(asked).repartition(parts, *keys, "m", "p").groupBy(*keys, "m", "p").applyInArrow(compared(threshold), "rep bigint, links bigint, root bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "rep"})
    each = classes.select("label", "h1", "h2", "rep", "w").join(links, "rep", "left").join(groups, "rep", "left")
    each = each.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("group"))
    group = F.coalesce("group", "vec_id")
    return keyed.select("vec_id", "label", "h1", "h2").join(each, ["label", "h1", "h2"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), group.alias("component_id"), (F.col("vec_id") == group).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings of one label with a cosine of 0.93 or more."""
    return linked(table(spark, sf_dir, "embeddings"))
