"""Centroid clustering by ball k-means on integer vectors: exact assignments, few comparisons.

A cluster is a ball: its centroid and the largest distance of a member. Balls whose centroids are farther apart than twice
the radius have no influence on each other's members, so each ball has a short list of neighbours, nearest first. A member
that is nearer to its centroid than half the way to the nearest neighbour lies in the stable core and is compared with
nothing; between half the way to the n-th and to the next neighbour lies the n-th annulus, whose members are compared with
the n nearest neighbours only. All comparisons use exact integers, so the clusters are those of a search of all centroids
(ties: the smaller number).

Each round is one pass over a table of packed vectors; a task returns one row of sums, count and radius for each cluster, and
the driver keeps the centroids (as many rows as clusters). A radius is carried to moved centroids by adding the way they
moved. The table names the ball in which a vector was last put; it is written anew every few rounds, as an old ball costs
comparisons and never changes the result.

Components are floor(scale * x) with x as double, held within +-2**26, so that squared distances fit 64 bits (x within
+-65 536 at the scale 1024). Vectors of another length, null vectors and vectors with a null or non-finite component are left
out. Rows with a null id are clustered but start no cluster; rows that share an id are separate vectors (a start goes to the
lesser vector first). With fewer vectors than clusters each vector starts one. Further columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import discard, stored, table

#: Components lie within plus and minus this.
MOST = 1 << 26
#: Rounds after which the table of vectors is written with their new balls.
RENEW = 3
#: Vectors compared at once in a task.
PIECE = 8192


def packed(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """vec_id and v (little-endian 32-bit integers) of the vectors that can be clustered."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size("embedding") == dimension) & sound).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), dimension)
            whole = np.clip(np.floor(x * scale), -MOST, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id bigint, v binary")


class Balls:
    """Centroids with what a member's comparisons need: the neighbours of each ball, nearest first."""

    def __init__(self, centroids: np.ndarray, radii: list[float]):
        self.centroids = centroids
        gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.order, self.gaps = [], []
        for i, row in enumerate(gap):
            near = [j for j in np.lexsort((np.arange(len(row)), row)).tolist() if j != i and not math.sqrt(int(row[j])) > 2 * radii[i]]
            self.order.append(np.array(near, dtype=np.int64))
            self.gaps.append(row[near])

    def nearest(self, v: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector and its squared distance, given the ball it is filed under; the squared distance to
        that ball's centroid; and the number of distances computed."""
        best, least, before, made = ball.copy(), np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64), 0
        for i in np.unique(ball).tolist():
            at = np.flatnonzero(ball == i)
            own = ((v[at] - self.centroids[i]) ** 2).sum(axis=1)
            # the member is in the annulus of as many neighbours as lie within twice its distance
            annulus = np.searchsorted(self.gaps[i], 4 * own, side="right")
            found, where = own.copy(), np.full(len(at), i)
            for n, j in enumerate(self.order[i].tolist()):
                open_ = np.flatnonzero(annulus > n)
                if not len(open_):
                    break
                d = ((v[at[open_]] - self.centroids[j]) ** 2).sum(axis=1)
                closer = (d < found[open_]) | ((d == found[open_]) & (j < where[open_]))
                found[open_[closer]], where[open_[closer]] = d[closer], j
                made += len(open_)
            best[at], least[at], before[at] = where, found, own
            made += len(at)
        return best, least, before, made


def assigned(rows: DataFrame, balls: Balls, dimension: int, keep: str) -> DataFrame:
    """``rows`` (vec_id, v, ball) put into the nearest ball. ``keep``: "vectors" (vec_id, v, ball), "distances" (vec_id,
    cluster, distance) or "sums" (one row for each task and ball: ball, n, made, sums, and radius, of what is filed under it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(balls.centroids)
        sums, count, radius, made = np.zeros((k, dimension), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), PIECE):
                part = batch.slice(lo, PIECE)
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<i4").reshape(len(part), dimension).astype(np.int64)
                filed = part.column(2).to_numpy().astype(np.int64)
                ball, distance, before, n = balls.nearest(v, filed)
                if keep == "vectors":
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ball.astype(np.int32))], ["vec_id", "v", "ball"])
                elif keep == "distances":
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ball.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
                else:
                    np.add.at(sums, ball, v)
                    np.add.at(count, ball, 1)
                    np.maximum.at(radius, filed, before)
                    made[0] += n
        if keep == "sums":
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(made), pa.array(radius), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["ball", "n", "made", "radius", "sums"])

    schema = {"vectors": "vec_id bigint, v binary, ball int", "distances": "vec_id bigint, cluster int, distance bigint", "sums": "ball int, n bigint, made bigint, radius bigint, sums array<bigint>"}
    return rows.mapInArrow(run, schema[keep])


def moved(rows: DataFrame, balls: Balls, dimension: int) -> tuple[np.ndarray, list[float], int]:
    """The centroids after one round, a bound of how far what is filed under each ball lies from them, and the distances computed."""
    parts = assigned(rows, balls, dimension, "sums").select("ball", "n", "made", "radius", F.posexplode("sums").alias("place", "x"))
    # each task's sums are exact 64-bit integers; those of all tasks may be larger
    # at most as many rows as clusters times components
    found = parts.groupBy("ball", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"), F.sum("made").alias("made"), F.max("radius").alias("radius")).collect()
    new, radii, made = balls.centroids.copy(), [0.0] * len(balls.centroids), 0
    for r in found:
        if r["n"]:
            new[r["ball"], r["place"]] = int(r["x"]) // r["n"]
        radii[r["ball"]] = math.sqrt(r["radius"])
        made += r["made"] if not r["place"] else 0
    shift = np.sqrt(((new - balls.centroids) ** 2).sum(axis=1).astype(np.float64)).tolist()
    # rounding of the square roots is far smaller than the added one
    return new, [r + s + 1 for r, s in zip(radii, shift, strict=True)], made


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dimension: int = 64, scale: int = 1024, said: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and n_members for each vector that can be
    clustered, after ``rounds`` rounds and one more assignment.

    The first centroids are the k vectors with the smallest lowercase-hex SHA-256 of ``salt`` and the id. ``said`` gets the
    number of distances computed in each round.
    """
    whole = stored(packed(vectors, dimension, scale))
    first = whole.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    starts = [np.frombuffer(r["v"], dtype="<i4").astype(np.int64) for r in first]
    centroids = np.array(starts, dtype=np.int64).reshape(len(starts), dimension)
    if not starts:
        rows, centroids = whole.limit(0), np.zeros((1, dimension), dtype=np.int64)
    else:
        rows = whole
    # all are filed under the first ball at first; a radius of infinity is one that isn't known yet
    rows, old, far = rows.select("vec_id", "v", F.lit(0).alias("ball")), whole, [math.inf] * len(centroids)
    balls = Balls(centroids, far)
    for i in range(rounds):
        if i % RENEW == 1:
            rows = stored(assigned(rows, balls, dimension, "vectors"))
            discard(old)
            old, balls = rows, Balls(centroids, far)
        centroids, radii, made = moved(rows, balls, dimension)
        balls = Balls(centroids, radii)
        if said is not None:
            said.append(made)
    last = stored(assigned(rows, balls, dimension, "distances"))
    discard(old)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.count(F.lit(1)).alias("n_members"))
    every = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # as many rows as clusters
    about = each.join(F.broadcast(every)).withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1))
    return last.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_members")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings of 64 components after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: greatest(-{MOST}, least({MOST}, floor(1024::DOUBLE * x::DOUBLE)))::BIGINT) AS v
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS j, v AS c FROM
 (SELECT sha256('3:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': j}}) AS m FROM kept, c{i} GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""n{i} AS MATERIALIZED (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM
 (SELECT j, place, sum(x) AS s, count(*) AS n FROM (SELECT m.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM kept JOIN a{i} USING (r)) GROUP BY j, place) GROUP BY j)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT o.j, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (j))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, m.j AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY m.j) AS n_members
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.j = m.j"""


SQL = _sql()
