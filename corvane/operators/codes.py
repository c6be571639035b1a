"""Hierarchical codes: keys, prefixes, relations by prefix, crosswalks, ranges and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digits(code: Column) -> Column:
    return F.regexp_replace(code, r"[^0-9]", "")


def key(code: Column) -> Column:
    """Digits of a dotted code; the zeros at the end of a fourth segment of three digits carry no meaning."""
    parts = F.split(code, r"\.")
    fourth = F.try_element_at(parts, F.lit(4))
    trimmed = F.when(F.length(fourth) == 3, F.regexp_replace(fourth, "0+$", "")).otherwise(fourth)
    return F.when(F.size(parts) >= 4, digits(F.concat(F.array_join(F.slice(parts, 1, 3), ""), trimmed))).otherwise(digits(code))


def prefixes(code: Column) -> Column:
    """The code cut at each of its dots, shortest first, itself included."""
    parts = F.split(code, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def key_prefixes(k: Column, least: int = 2) -> Column:
    """All prefixes of a key of ``least`` digits or more."""
    return F.when(F.length(k) >= least, F.transform(F.sequence(F.lit(least), F.length(k)), lambda n: F.substring(k, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def related(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of rows of which one key is a prefix of the other, with ``relation`` = length(right) - length(left).

    Both directions are equi-joins on exploded prefixes, so no pairs are compared that don't match.
    """
    up = left.withColumn("_p", F.explode(key_prefixes(F.col(left_key), 1))).join(right.withColumn("_p", F.col(right_key)), "_p")
    down = left.withColumn("_p", F.col(left_key)).join(right.withColumn("_p", F.explode(key_prefixes(F.col(right_key), 1))), "_p").where(F.length(right_key) > F.length(left_key))
    relation = (F.length(right_key) - F.length(left_key)).cast("bigint")
    return up.unionByName(down).drop("_p").withColumn("relation", relation)


def nearest_ancestor(rows: DataFrame, known: DataFrame, code: str, name: str) -> DataFrame:
    """Add the name of the deepest known ancestor (or the code itself): ``found_code`` and ``found_name``; repeated rows stay."""
    names = known.where(F.col(name).isNotNull()).groupBy(F.col(code).alias("_p")).agg(F.min(name).alias("_n"))
    up = rows.select(F.col(code).alias("_c")).distinct().withColumn("_p", F.explode(prefixes(F.col("_c")))).join(names, "_p")
    found = up.groupBy("_c").agg(F.max_by(F.struct("_p", "_n"), F.length("_p")).alias("_f"))
    return rows.join(found, F.col(code) == F.col("_c"), "left").select(*[rows[c] for c in rows.columns], F.col("_f._p").alias("found_code"), F.col("_f._n").alias("found_name"))


def crosswalk(rows: DataFrame, pairs: DataFrame, code: str, short: int) -> DataFrame:
    """Translate by (source, target) pairs: the exact code, or else its first ``short`` characters if it is longer."""
    exact = rows.join(pairs, F.col(code) == F.col("source"), "left").select(rows["*"], "target")
    hit = exact.where("target IS NOT NULL").withColumn("way", F.lit("exact"))
    rest = exact.where("target IS NULL").drop("target")
    cut = rest.join(pairs, (F.substring(code, 1, short) == F.col("source")) & (F.length(code) > short), "left").select(*[rest[c] for c in rest.columns], "target")
    return hit.unionByName(cut.withColumn("way", F.when(F.col("target").isNotNull(), "short").otherwise("none")))


def in_range(code: Column, low: Column, high: Column) -> Column:
    """'exact' if the whole of the code lies in [low, high], 'narrower' if only a part below it does, else 'none'.

    Keys are compared at the depth that they share; the upper bound holds everything below it.
    """
    top = F.coalesce(high, low)
    at = lambda a, b: F.substring(a, F.lit(1), F.least(F.length(a), F.length(b)))
    inside = (at(code, low) >= at(low, code)) & (at(code, top) <= at(top, code))
    deeper = ((at(code, low) == at(low, code)) & (F.length(code) < F.length(low))) | ((at(code, top) == at(top, code)) & (F.length(code) < F.length(top)))
    return F.when(inside & ~deeper, "exact").when(inside, "narrower").otherwise("none")


def inherited(rows: DataFrame, key_col: str, parent: str, value: str) -> DataFrame:
    """Fill a missing value from the row that ``parent`` names (of several, the least value); ``inherited`` tells where."""
    above = rows.groupBy(F.col(key_col).alias(parent)).agg(F.min(value).alias("_v"))
    out = rows.join(above, parent, "left")
    taken = F.col(value).isNull() & F.col("_v").isNotNull()
    return out.withColumn("inherited", taken).withColumn(value, F.coalesce(value, "_v")).drop("_v")


def collapsed_schedule(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Runs of equal values of neighbouring years as one row: first, last, and a label such as ``2024-2026``."""
    w = Window.partitionBy(*keys).orderBy(year)
    new = ~(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.col(year) == F.lag(year).over(w) + 1))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(w)).groupBy(*keys, "_run", value).agg(F.min(year).alias("first"), F.max(year).alias("last"))
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return runs.withColumn("label", label).drop("_run")
