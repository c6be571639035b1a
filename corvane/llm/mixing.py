"""Mixing sources to target weights by Pfair scheduling. Native DataFrame code only.

Every source's documents are cut into blocks. Block i of a source with weight w may run from slot floor(i / w) on and
must run before slot ceil((i + 1) / w); in each slot the released block with the earliest deadline runs. So after any
number of slots each source has had its share within less than one block, as long as it has blocks left.

The weights are the exact targets (whole numbers as given, others as fractions of 2**50); a weight of zero is the least
fraction, and if all are zero they are equal. The schedule is worked out on the driver from the weights and the number of
blocks of each source alone, one step for each block, and sent to the tasks as one number for each block. There are about
MOST_BLOCKS blocks at most (and one more for each source), whatever the input: beyond that a block holds more documents.
Documents stay where they are, and none is dropped or repeated. A source that runs out leaves its slots empty or to
blocks that are released already.

A null source is a source of its own. Rows with a null id are left out; repeated ids and rows each keep a place (in the
order of a hash of the row). Ids may be any 64-bit numbers. Further columns are kept, whatever their names; those with the
name of a new column are replaced. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import id_bucket, table

#: Least documents in a block; blocks in a row of the plan; most blocks but one for each source, which are planned on the
#: driver and broadcast (8 bytes each); most sources.
BLOCK, CHUNK, MOST_BLOCKS, MOST_SOURCES = 8, 1024, 1 << 20, 100_000
#: Sum of the weights that aren't whole numbers, as whole numbers.
SCALE = 1 << 50
NO_SOURCE = "(none)"
#: Column of the mixing stage's result: the place in the mix.
PLACE = "mix_position"


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Weights in proportion as whole numbers, at least one: as they are if they are whole, or else as parts of SCALE."""
    if any(not w >= 0 for w in weights.values()):
        raise ValueError("weights must be numbers from zero on")
    total = sum(weights.values())
    if not total:
        return dict.fromkeys(weights, 1)
    if total < SCALE and all(w >= 1 and w == int(w) for w in weights.values()):
        return {s: int(w) for s, w in weights.items()}
    return {s: max(1, round(w / total * SCALE)) for s, w in weights.items()}


def schedule(weight: dict[str, int], blocks: dict[str, int]) -> dict[str, array]:
    """The slot of every block of each source: earliest deadline first among the released blocks."""
    total = sum(weight.values())
    out = {s: array("q") for s in blocks}
    waiting = [(0, s) for s in sorted(blocks) if blocks[s]]  # (release of the source's next block, source)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * total // weight[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(slot)
        slot += 1
        if len(out[s]) < blocks[s]:
            heapq.heappush(waiting, (len(out[s]) * total // weight[s], s))
    return out


def plan(spark: SparkSession, slots: dict[str, array], weight: dict[str, int]) -> DataFrame:
    """_source, _w and, for each CHUNK blocks, _chunk and their slots."""
    cut = [(s, i) for s, x in slots.items() for i in range(0, len(x), CHUNK)]
    columns = [
        pa.array([s for s, _ in cut], pa.string()),
        pa.array([weight[s] for s, _ in cut], pa.int64()),
        pa.array([i // CHUNK for _, i in cut], pa.int64()),
        pa.array([slots[s][i : i + CHUNK] for s, i in cut], pa.list_(pa.int64())),
    ]
    return spark.createDataFrame(pa.table(columns, ["_source", "_w", "_chunk", "_slots"]))


def numbered(docs: DataFrame, group: str) -> DataFrame:
    """Add ``nr``: 0, 1, ... within each group in the order of id and tie, without bringing a group into one task.

    Row numbers within a group's bucket of ids are moved by the counts of the buckets before it, which are few.
    """
    docs = docs.withColumn("bucket", id_bucket(docs, "id"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n")).select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    docs = docs.withColumn("rn", F.row_number().over(Window.partitionBy(group, "bucket").orderBy("id", "tie")))
    return docs.join(starts, [group, "bucket"]).withColumn("nr", F.col("start") + F.col("rn") - 1).drop("bucket", "rn", "start")


def square_root_weights(counts: dict[str, int]) -> dict[str, float]:
    """Target weights in proportion to the square root of each source's size."""
    return {s: n**0.5 for s, n in counts.items()}


NEW = ("source_weight", "block_no", "release_slot", "deadline_slot", "slot", "position")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None) -> DataFrame:
    """Add to ``docs`` (doc_id, source, any others): source_weight, block_no, release_slot, deadline_slot, slot, position.

    ``weights``: target weight by source, by default the square root of its count. Sources without a weight get the
    smallest one, so that nothing is dropped. ``block``: documents in a block, by default BLOCK or so many more that there
    are at most about MOST_BLOCKS of them.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "source")]
    # all that the caller's rows hold but id and source stands in one struct, so that no name can clash
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit(NO_SOURCE)).alias("name"), F.col("source").isNull().alias("no_name"), rest.alias("rest"))
    rows = rows.withColumn("tie", F.xxhash64("name", "rest") if others else F.lit(0))
    found = rows.groupBy("name").count().limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; give weights for groups of sources")
    counts = {r["name"]: r["count"] for r in found}
    if weights is None:
        weights = square_root_weights(counts)
    elif weights:
        weights = {s: weights.get(s, min(weights.values())) for s in counts}
    else:
        weights = dict.fromkeys(counts, 1.0)
    weight = whole(weights)
    total = sum(weight.values())
    block = block or max(BLOCK, -(-sum(counts.values()) // MOST_BLOCKS))
    slots = schedule(weight, {s: -(-n // block) for s, n in counts.items()})
    out = numbered(rows, "name").withColumn("block_no", F.expr(f"nr div {block}")).withColumn("_chunk", F.expr(f"block_no div {CHUNK}")).withColumnRenamed("name", "_source")
    out = out.join(F.broadcast(plan(spark, slots, weight)), ["_source", "_chunk"])
    out = out.withColumn("slot", F.expr(f"_slots[int(block_no % {CHUNK})]"))
    # products of block numbers and weights are longer than a bigint
    long = lambda x: f"cast({x} AS decimal(18, 0))"
    own = {"doc_id": F.col("id"), "source": F.when(~F.col("no_name"), F.col("_source"))}
    return out.select(
        *[own.get(c.lower(), F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c.lower() not in NEW],
        (F.col("_w") / F.lit(total)).alias("source_weight"),
        "block_no",
        F.expr(f"({long('block_no')} * {long(total)}) div {long('_w')}").alias("release_slot"),
        F.expr(f"({long('block_no + 1')} * {long(total)} + {long('_w - 1')}) div {long('_w')}").alias("deadline_slot"),
        "slot",
        F.expr(f"slot * {block} + nr % {block}").alias("position"),
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of its sources."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents with their place in the mix (PLACE, in the stead of any such column), in that order."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = mixed(docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))).select("position", "_row")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() != PLACE]
    return place.repartitionByRange(n, "position").sortWithinPartitions("position").select(*kept, F.col("position").alias(PLACE))
