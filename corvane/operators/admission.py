"""Admission under several caps at once, as reserve-then-count: in the order of time each request takes a place under the caps, is
counted with itself, and gives the place back if one of them is passed; a refund gives it back later.

A cap is a running sum for each of its keys: one more where a request is admitted, one less where its place is free again (a
refund, or the end of a window).

Whether a request is admitted depends on the requests before it under all caps. Time is cut into blocks of about ``ROWS`` requests
(at quantiles, so a crowded hour is many blocks). A block is judged in the order of time in one task, from the places that are
taken at its start; those come from the verdicts of the round before, at first from none. Rounds go on until no verdict changes.
What a round finds is right for every block all of whose predecessors were right, so a state without changes is *the* sequential
result, and each round settles at least the earliest open block; caps of a day settle all days at once. A task keeps the counts of
its block's keys and the places that become free, not its rows. Requests of one instant lie in one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources import store


@dataclass(frozen=True)
class Cap:
    """``limit`` admitted requests for each ``key`` (a column expression). A place is free again after ``window`` seconds, or, if
    ``refunds``, from the time ``refund_ts`` of its request on."""

    name: str
    key: str
    limit: int
    window: float | None = None
    refunds: bool = True


#: Requests in a block of time.
ROWS = 50_000
#: Never, as a time in microseconds.
NEVER = 2**63 - 1


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _freed(cap: Cap) -> Column:
    """When a request's place under the cap is free again, in microseconds."""
    ends = [F.col("at") + F.lit(round(cap.window * 1_000_000))] if cap.window else []
    ends += [_micros(F.col("refund_ts"))] if cap.refunds else []
    return F.least(F.lit(NEVER), *ends) if ends else F.lit(NEVER)  # least passes over nulls


def _prepared(requests: DataFrame, caps: list[Cap], borders: list[int]) -> DataFrame:
    """event_id, at, its block b, and for each cap its key, the time at which a place is free again and that time's block."""

    @F.pandas_udf("int")
    def block(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, dtype=np.int64), at.to_numpy(), side="right").astype(np.int32))

    keys = [F.coalesce(F.concat(F.lit(" "), F.expr(cap.key).cast("string")), F.lit("")) for cap in caps]
    rows = requests.withColumn("at", _micros(F.col("ts"))).where("at IS NOT NULL")
    rows = rows.select("event_id", "at", F.array(*keys).alias("keys"), F.array(*map(_freed, caps)).alias("freed"))
    return rows.select("*", block("at").alias("b"), F.array(*[block(F.col("freed")[c]) for c in range(len(caps))]).alias("blocks"))


def judge_blocks(names: list[str], limits: list[int]):
    """Judge rows that are sorted by block, kind o, time and id. Kinds: 0 the places taken under a key (n) at the block's start,
    1 a place taken in an earlier block, free at a time of this one, 2 a request (n = 1: one that has its places already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, free = None, {}, []
        for batch in batches:
            said = []
            lists = (batch.column(name).to_pylist() for name in ("b", "o", "at", "keys", "freed", "cap", "n"))
            for b, o, at, keys, freed, cap, n in zip(*lists, strict=True):
                if b != block:
                    block, held, free = b, {}, []
                if o == 0:
                    held[cap, keys[0]] = n
                elif o == 1:
                    heapq.heappush(free, (at, cap, keys[0]))
                else:
                    while free and free[0][0] <= at:  # at one time places become free before requests are judged
                        _, c, k = heapq.heappop(free)
                        held[c, k] = held.get((c, k), 0) - 1
                    full = None if n else next((c for c, k in enumerate(keys) if held.get((c, k), 0) >= limits[c]), None)
                    if not n:
                        said.append("admitted" if full is None else names[full])
                    if full is None:
                        for c, (k, end) in enumerate(zip(keys, freed, strict=True)):
                            if end > at:  # a place that is free at once is none
                                held[c, k] = held.get((c, k), 0) + 1
                                if end < NEVER:
                                    heapq.heappush(free, (end, c, k))
            rows = batch.filter(pc.and_(pc.equal(batch.column("o"), 2), pc.equal(batch.column("n"), 0)))
            verdicts = pa.array(said, pa.string())
            changed = pc.not_equal(rows.column("verdict"), verdicts)
            columns = {name: rows.column(name) for name in ("event_id", "at", "keys", "freed", "b", "blocks")}
            yield pa.RecordBatch.from_pydict(columns | {"verdict": verdicts, "changed": pc.fill_null(changed, True)})

    return run


def _round(rows: DataFrame, earlier: DataFrame | None, caps: list[Cap]) -> DataFrame:
    """Judge all blocks by the places that the verdicts of ``rows`` and the earlier requests take before them."""
    rows = rows.select("event_id", "at", "keys", "freed", "b", "blocks", "verdict", F.lit(0).cast("bigint").alias("n"))
    if earlier is not None:
        rows = rows.unionByName(earlier.withColumn("verdict", F.lit("admitted")).withColumn("n", F.lit(1).cast("bigint")))
    number = F.sequence(F.lit(0), F.lit(len(caps) - 1))
    places = rows.where("verdict = 'admitted'").select("b", "at", F.explode(F.arrays_zip(number.alias("cap"), F.col("keys").alias("k"), F.col("freed").alias("end"), F.col("blocks").alias("last"))).alias("p"))
    # places that aren't free again inside of their own block: they count from the next block up to the one in which they become free
    places = places.select("b", "at", "p.*").where(f"end > at AND (last > b OR end = {NEVER})")
    back = places.where(f"end < {NEVER}")
    steps = places.select("cap", "k", (F.col("b") + 1).alias("b"), F.lit(1).cast("bigint").alias("step"), F.lit(0).alias("asked"))
    steps = steps.union(back.select("cap", "k", F.col("last") + 1, F.lit(-1).cast("bigint"), F.lit(0)))
    asked = rows.select("b", F.explode(F.arrays_zip(number.alias("cap"), F.col("keys").alias("k"))).alias("p")).select("p.cap", "p.k", "b", F.lit(0).cast("bigint"), F.lit(1))
    sums = steps.union(asked).groupBy("cap", "k", "b").agg(F.sum("step").alias("n"), F.max("asked").alias("asked"))
    held = sums.withColumn("n", F.sum("n").over(Window.partitionBy("cap", "k").orderBy("b"))).where("asked = 1 AND n <> 0")
    no = lambda kind: F.lit(None).cast(kind)
    other = lambda df, o, b, at, n: df.select(F.col(b).alias("b"), F.lit(o).alias("o"), at.alias("at"), no("bigint").alias("event_id"), F.array("k").alias("keys"), no("array<bigint>").alias("freed"), no("array<int>").alias("blocks"), "cap", n.alias("n"), no("string").alias("verdict"))
    dealt = rows.withColumn("o", F.lit(2)).withColumn("cap", no("int")).unionByName(other(held, 0, "b", no("bigint"), F.col("n"))).unionByName(other(back, 1, "last", F.col("end"), no("bigint")))
    dealt = dealt.repartition("b").sortWithinPartitions("b", "o", "at", "event_id")
    return dealt.mapInArrow(judge_blocks([c.name for c in caps], [c.limit for c in caps]), "event_id bigint, at bigint, keys array<string>, freed array<bigint>, b int, blocks array<int>, verdict string, changed boolean")


def admitted(requests: DataFrame, caps: list[Cap], earlier: DataFrame | None = None, block: int = ROWS) -> DataFrame:
    """event_id and ``verdict`` of requests (event_id, ts, refund_ts and the caps' columns): 'admitted', or the name of the first
    cap that was full. ``earlier`` holds requests admitted before, of the same columns; their places count. Requests without a
    time are left out."""
    requests = requests.withColumn("refund_ts", F.col("refund_ts") if "refund_ts" in requests.columns else F.lit(None).cast("timestamp"))
    times = requests.select(_micros(F.col("ts")).alias("at"))
    n = -(-times.count() // block)
    borders = sorted({int(x) for x in times.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    before = None if earlier is None else store.stored(_prepared(earlier.select(*requests.columns), caps, borders), "earlier")
    rows = _prepared(requests, caps, borders).withColumn("verdict", F.lit(None).cast("string"))
    while True:
        rows = store.stored(_round(rows, before, caps), "verdicts")
        if rows.where("changed").isEmpty():
            return rows.select("event_id", "verdict")


def admit_stream(requests: DataFrame, caps: list[Cap], path: str):
    """A writer of a stream of requests: each batch is judged after all that was admitted before it. ``path`` gets a folder for
    each batch with the requests and their verdicts, so a batch that comes again gives the same rows. Late requests are judged by
    what was admitted in time before them and since then, as places once given are kept."""

    def judge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = history(spark, path, epoch).where("verdict = 'admitted'").drop("verdict", "epoch") if epoch else None
        batch = batch.withColumn("refund_ts", F.col("refund_ts") if "refund_ts" in batch.columns else F.lit(None).cast("timestamp"))
        batch = store.stored(batch, "requests")
        batch.join(admitted(batch, caps, before), "event_id").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return requests.writeStream.foreachBatch(judge)


def history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All judged requests of a stream, or those of the batches before one."""
    rows = spark.read.parquet(path)
    return rows if before is None else rows.where(F.col("epoch") < before)
