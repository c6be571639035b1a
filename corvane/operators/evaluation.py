"""Metrics of ranked results: recall, reciprocal rank, collisions, spread, thresholds, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(rank: Column, k: int) -> Column:
    """Share of rows with a rank up to k (an aggregate); a missing rank counts as a miss, no rows as 0."""
    return F.coalesce(F.avg(F.coalesce(rank <= k, F.lit(False)).cast("int")), F.lit(0.0))


def mrr(rank: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0))


def first_rank(ranked: DataFrame, wanted: Column, query_id: str = "query_id") -> DataFrame:
    """The first rank at which a wanted item stands for each query; null if none does."""
    return ranked.groupBy(query_id).agg(F.min(F.when(wanted, F.col("rank"))).alias("rank"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in an order that the key's digest and a seed give (a report's sample; the same in any engine)."""
    w = Window.partitionBy(stratum).orderBy(F.sha1(F.concat_ws(":", F.lit(seed), key)), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def trade_off(scores: DataFrame, thresholds: DataFrame, score: str, good: str) -> DataFrame:
    """For each threshold (a short list) how many bad rows pass it and how many good ones it flags."""
    both = scores.join(F.broadcast(thresholds))
    return both.groupBy("threshold").agg(F.count_if((F.col(score) >= F.col("threshold")) & ~F.col(good)).alias("false_accept"), F.count_if((F.col(score) < F.col("threshold")) & F.col(good)).alias("false_flag"))
