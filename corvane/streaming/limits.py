"""Streams with state by key: a sliding-window limiter that rejects, windows with late data, first-seen rows, refreshes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(admitted: list[float], ts: float, limit: int, window: float) -> tuple[bool, float, list[float]]:
    """Whether an event is admitted, after how many seconds to try again if not, and the admitted times from then on.

    An admitted event counts for ``window`` seconds; one just as old no longer counts. Rejected events take no place.
    """
    kept = [t for t in admitted if t > ts - window]
    if len(kept) >= limit:
        return False, round(kept[0] + window - ts, 6), kept
    return True, 0.0, [*kept, ts]


def limited_batch(events: DataFrame, key: str, limit: int, window: float) -> DataFrame:
    """The limiter over a table (key, event_id, ts): event_id, admitted, retry_after.

    Decisions depend on those before them, so each key's events go through one group in order. A state of ``limit``
    times is all that is held of them: groups are read batch by batch.
    """
    rows = events.select(F.col(key).alias("k"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("ts"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for pdf in batches:
            out = []
            for k, event_id, ts in zip(pdf["k"], pdf["event_id"], pdf["ts"], strict=True):
                if k != at:
                    at, kept = k, []
                ok, retry, kept = admit(kept, ts, limit, window)
                out.append((event_id, ok, retry))
            yield pd.DataFrame(out, columns=["event_id", "admitted", "retry_after"])

    return ordered.mapInPandas(run, "event_id bigint, admitted boolean, retry_after double")


def limited_stream(events: DataFrame, key: str, limit: int, window: float, late: str = "1 hour") -> DataFrame:
    """The limiter over a stream; a key's state is dropped when the watermark has passed its last admitted event's window."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(pdf["event_id"], pdf["ts"], strict=True):
            ok, retry, kept = admit(kept, ts, limit, window)
            out.append((event_id, ok, retry))
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((kept[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "admitted", "retry_after"])

    rows = events.select(F.col(key).alias("k"), "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late).withColumn("ts", F.col("at").cast("double"))
    return rows.groupBy("k").applyInPandasWithState(run, "event_id bigint, admitted boolean, retry_after double", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str, length: str, step: str | None = None) -> DataFrame:
    """Counts and sums by time window and kind; rows later than ``late`` are dropped. Works on tables and streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, step) if step else F.window("ts", length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys were not seen within ``late`` before."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def write_by_scope(path: str, scope: str):
    """A foreachBatch writer: each scope (folder) that a batch holds is replaced as a whole; replays give the same table."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)

    return write


def write_log(path: str, mark: str):
    """A foreachBatch writer of log lines: a mark and a JSON object for each row, one folder for each batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(F.concat(F.lit(mark), F.to_json(F.struct(*batch.columns))).alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch}")

    return write
