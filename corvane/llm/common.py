"""Helpers shared by the training-data operators: reading tables, durable cuts of the lineage, array hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any supported store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is local
    (tests) is a temporary folder used.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for rows with texts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of a ``stored`` DataFrame that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Buckets of ids for each shuffle partition.
ID_BUCKETS = 4


def id_bucket(df: DataFrame, id_col: str) -> Column:
    """The number of a row's bucket: ascending ranges of the id with about equally many rows, whatever the ids are.

    The borders are approximate quantiles of all ids, so many for each shuffle partition (a bounded list on the driver).
    """
    n = ID_BUCKETS * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(F.col(id_col), [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    borders = sorted(set(found))
    if not borders:
        return F.lit(0)
    steps = [1 << i for i in range(len(borders).bit_length() - 1, -1, -1)]
    at = F.lit(0)
    known = F.array(*map(F.lit, borders))
    # a binary search: how many borders lie at or under the id
    return F.aggregate(F.array(*map(F.lit, steps)), at, lambda lo, step: F.when((lo + step <= len(borders)) & (F.try_element_at(known, lo + step) <= F.col(id_col)), lo + step).otherwise(lo))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the polynomial hashes, its inverse modulo 2**64, and one random 64-bit value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64 (n values)."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


#: ASCII white space: the space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of UTF-8 texts, with a 64-bit hash of each, computed as arrays.

    ``start``/``end`` are byte offsets in ``data``; ``doc`` is the index of the text; ``first`` has, for each text, the
    index of its first word (and one more entry at the end).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.begin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(self.sizes + 1, out=self.begin[1:])
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = ~SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(raw)
        power = powers(BASE, n)
        values = BYTE_VALUES[LOWER[raw]] if lower else BYTE_VALUES[raw]
        values = values * power
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=prefix[1:])
        del values, power
        back = powers(INVERSE, n)
        self.hash = mix64((prefix[self.end] - prefix[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on (the last k - 1 entries run over the end and mean nothing)."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            part = np.zeros(n, dtype=np.uint64)
            part[: max(0, n - i)] = self.hash[i:]
            out = out * BASE + part
        return mix64(out)


def batches(texts, limit: int):
    """Cut positions so that each piece of the list has about ``limit`` bytes (a longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, component (its smallest node), for all nodes that have a link.

    Large-star and small-star steps until nothing changes. The links come from tasks that found them by union-find, so
    that few are left over; no Python worker beside those is needed here.
    """
    ends = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    e = cut(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = (state["n"], state["h"])
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
