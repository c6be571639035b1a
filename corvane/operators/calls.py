"""Calls to something outside of Spark (a model, a registry) for the distinct keys of a table, in batches, with a cache.

    calls.called(rows, "text", client, "array<double>", path)

``client`` is a function without arguments that a task calls once; it gives a function from a list of keys to a list of values.
Keys are made distinct first, so a key that a third of the rows have is asked for once; keys that the cache (a Parquet table in
``path``: key, value) holds are not asked for at all. A batch that fails is tried again after a pause, then key by key, so that one
bad key costs no other; what still fails is a row with the error, and isn't cached. Results reach the cache when all of a call's
tasks have ended (Spark's commit), so a task that is run again leaves no second copy; its keys are asked for again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from corvane.sources import store

#: Keys of one call and of one task; tries for a batch, and seconds before the second one (doubled for each further one).
BATCH, TASK_KEYS, TRIES, PAUSE = 64, 10_000, 3, 0.1

Client = Callable[[], Callable[[list], list]]


def tried(ask: Callable[[list], list], keys: list, tries: int = TRIES, pause: float = PAUSE) -> list[tuple[object, str | None]]:
    """A value or an error for each key."""
    for n in range(tries):
        try:
            values = ask(keys)
            if len(values) != len(keys):
                raise ValueError(f"{len(values)} values for {len(keys)} keys")
            return [(v, None) for v in values]
        except Exception as e:  # noqa: BLE001 - whatever a client raises becomes an error row
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(pause * 2**n)
    if len(keys) == 1:
        return [(None, error)]
    return [x for k in keys for x in tried(ask, [k], tries, pause)]


def answers(keys: DataFrame, client: Client, kind: str, batch: int = BATCH) -> DataFrame:
    """key, value and error for a table of distinct keys (one column, key)."""
    of = StructType([StructField("key", keys.schema["key"].dataType), *StructType.fromDDL(f"value {kind}").fields, StructField("error", StringType())])
    types = [to_arrow_type(f.dataType) for f in of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for rows in batches:
            ask = ask or client()
            for lo in range(0, len(rows), batch):
                some = rows.column(0).slice(lo, batch).to_pylist()
                found = tried(ask, some)
                yield pa.RecordBatch.from_arrays([pa.array(some, types[0]), pa.array([v for v, _ in found], types[1]), pa.array([e for _, e in found], types[2])], of.names)

    return keys.mapInArrow(run, of)


def called(rows: DataFrame, key: str, client: Client, kind: str, path: str, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``value`` and ``error`` of each row's key (both null for a null key)."""
    spark = rows.sparkSession
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    schema = StructType([keys.schema["key"], *StructType.fromDDL(f"value {kind}").fields])
    known = spark.read.schema(schema).parquet(path) if store.exists(spark, path) else None
    missing = store.stored(keys if known is None else keys.join(known.select("key"), "key", "left_anti"), "keys")
    n = missing.count()
    failed = None
    if n:
        asked = store.stored(answers(missing.repartition(max(1, -(-n // TASK_KEYS))), client, kind, batch), "answers")
        asked.where("error IS NULL").select("key", "value").write.mode("append").parquet(path)
        failed = asked.where("error IS NOT NULL").select("key", F.lit(None).cast(kind).alias("value"), "error")
    known = spark.read.schema(schema).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], schema)
    both = known.withColumn("error", F.lit(None).cast("string"))
    both = both if failed is None else both.unionByName(failed)
    return rows.join(both.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
