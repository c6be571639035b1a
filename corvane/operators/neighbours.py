"""Approximate nearest neighbours: a stored inverted file of coarse cells, searched in as many cells as a measured recall needs.

``build`` fits centroids on a bounded sample, puts *every* item into the cell of its nearest centroid and stores the items as
Parquet partitioned by cell, with two small tables beside them: the centroids with their numbers of items, and the share of true
neighbours that the first p cells of a query hold, measured by an exact search for a bounded number of queries. ``search`` ranks
the cells for each query, takes as many as the aimed recall needs (and hold k items), and reads only the partitions of cells that
some query takes; large cells are split into blocks, so no cell is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corvane.operators import retrieval
from corvane.sources import store

#: Vectors that centroids are fitted on, vectors for each centroid, and queries that the recall is measured with.
SAMPLE, PER_CELL, MEASURED = 65_536, 32, 256
#: Rounds of the fit.
ROUNDS = 12


@dataclass(frozen=True)
class Index:
    """A stored inverted file. ``recall[p - 1]`` is the share of true neighbours in the first p cells."""

    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    recall: list[float]

    def probes(self, aim: float) -> int:
        """How many cells hold the aimed share of true neighbours."""
        return next((p for p, r in enumerate(self.recall, 1) if r >= aim), len(self.centroids))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fitted(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids by rounds of spherical k-means from evenly spread starts; an empty cell takes the point farthest from its own."""
    rng = np.random.default_rng(17)
    centroids = points[rng.choice(len(points), size=min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        near = points @ centroids.T
        cell, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, points)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = points[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def ranked_cells(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All cells for each vector, nearest centroid first (ties: the smaller number)."""
    return np.argsort(-np.round(x @ centroids.T, 9), axis=1, kind="stable")


def with_cells(rows: DataFrame, vector: str, centroids: np.ndarray, probes: int, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Add ``cells``: the nearest cells of each row's vector, ``probes`` of them or as many as hold ``least`` items."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, sizes))  # at most SAMPLE / PER_CELL centroids
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                x = np.array(part.column(vector).to_pylist(), dtype=np.float64).reshape(len(part), -1)
                order = ranked_cells(centroids, x)
                if sizes is None:
                    cells = order[:, :probes].tolist()
                else:
                    enough = np.maximum((np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1, probes)
                    cells = [o[:n].tolist() for o, n in zip(order, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int32()))], [*part.schema.names, "cells"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))


def build(items: DataFrame, path: str, item_id: str = "item_id", vector: str = "vector", k: int = 10) -> Index:
    """Store the items (ids as bigint) in ``path``; the recall is measured for the k nearest items."""
    spark = items.sparkSession
    items = items.where(F.col(item_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(vector).alias("vector"))
    n = items.count()
    drawn = items.sample(min(1.0, 1.2 * SAMPLE / max(1, n)), seed=3).limit(SAMPLE).select("vector").collect() if n else []
    points = unit(np.array([r["vector"] for r in drawn], dtype=np.float64)) if drawn else np.zeros((0, 1))
    cells = max(1, min(round(n**0.5), len(points) // PER_CELL, SAMPLE // PER_CELL))
    centroids = fitted(points, cells) if len(points) else points
    placed = with_cells(items, "vector", centroids, 1).select("item_id", "vector", F.element_at("cells", 1).alias("cell")) if len(points) else items.withColumn("cell", F.lit(0))
    # a few files for a large cell: rows of a cell are dealt by hashes of ids as well
    spread = max(1, round(n / max(1, cells) / 1_000_000))
    placed.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(spread))).write.partitionBy("cell").parquet(f"{path}/items")
    stored = spark.read.schema("item_id bigint, vector " + items.schema["vector"].dataType.simpleString() + ", cell int").parquet(f"{path}/items")
    counts = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}  # a row for each cell
    sizes = [counts.get(i, 0) for i in range(len(centroids))]
    recall = measured(stored, centroids, n, k) if n else []
    spark.createDataFrame([(i, c.tolist(), s) for i, (c, s) in enumerate(zip(centroids, sizes, strict=True))], "cell int, centroid array<double>, n bigint").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame(list(enumerate(recall, 1)), "probes int, recall double").coalesce(1).write.parquet(f"{path}/recall")
    return load(spark, path)


def measured(items: DataFrame, centroids: np.ndarray, n: int, k: int) -> list[float]:
    """The share of true neighbours in the first p cells, for all p, from exact searches for at most MEASURED items."""
    chosen = items.orderBy(F.xxhash64("item_id")).limit(MEASURED).select("item_id", "vector").collect()
    queries = items.sparkSession.createDataFrame([(r["item_id"], r["vector"]) for r in chosen], items.select(F.col("item_id").alias("query_id"), "vector").schema)
    near = retrieval.knn(queries, items.select("item_id", "vector"), k + 1).where("item_id <> query_id")
    # at most MEASURED times k rows
    found = near.join(items.select("item_id", "cell"), "item_id").select("query_id", "cell").collect()
    order = {r["item_id"]: row for r, row in zip(chosen, ranked_cells(centroids, np.array([r["vector"] for r in chosen], dtype=np.float64)), strict=True)}
    places = np.array([int(np.flatnonzero(order[r["query_id"]] == r["cell"])[0]) for r in found], dtype=np.int64)
    if not len(places):
        return [1.0] * len(centroids)
    return (np.cumsum(np.bincount(places, minlength=len(centroids))) / len(places)).tolist()


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    recall = spark.read.parquet(f"{path}/recall").orderBy("probes").collect()
    return Index(path, np.array([r["centroid"] for r in cells], dtype=np.float64), np.array([r["n"] for r in cells], dtype=np.int64), [r["recall"] for r in recall])


def search(queries: DataFrame, index: Index, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector", recall: float = 0.99) -> DataFrame:
    """The nearest items by dot product in the cells that the aimed recall needs: query id, item id, score, rank."""
    spark = queries.sparkSession
    asked = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    if not len(index.centroids):
        return asked.limit(0).select(F.col("q").alias(query_id), F.lit(0).cast("bigint").alias(item_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    probed = with_cells(asked, "v", index.centroids, index.probes(recall), index.sizes, k).select("q", "v", F.explode("cells").alias("cell"))
    # one row for each cell that some query takes
    wanted = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect()}
    items = spark.read.parquet(f"{index.path}/items").where(F.col("cell").isin(sorted(wanted))).select("cell", F.col("item_id").alias("i"), F.col("vector").alias("v"))
    blocks = [(c, max(1, -(-int(index.sizes[c]) // retrieval.BLOCK)), max(1, -(-n // retrieval.QUERIES))) for c, n in sorted(wanted.items())]
    plan = F.broadcast(spark.createDataFrame(blocks, "cell int, _nb int, _nm int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    cut = items.join(plan, "cell").select("cell", own("i", "_nb").alias("_b"), every("_nm").alias("_m"), "i", "v")
    ask = probed.join(plan, "cell").select("cell", every("_nb").alias("_b"), own("q", "_nm").alias("_m"), "q", "v")
    keys = ["cell", "_b", "_m"]
    found = ask.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInArrow(retrieval.best_of_block(k), "q bigint, i bigint, s double")
    ranked = retrieval.top_k(found, "q", [F.desc("s"), F.asc("i")], k)
    return ranked.select(F.col("q").alias(query_id), F.col("i").alias(item_id), F.col("s").alias("score"), "rank")
