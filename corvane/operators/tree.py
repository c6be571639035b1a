"""Trees given by parent keys: the way up from every key, and the texts of what stands above a row.

Ways are found by pointer doubling: each round joins every key's way so far with the way of the key where it ends, so a tree of
depth d takes about log2(d) joins, and a chain of any length is followed. A way stops at a key that several rows have (it isn't
known which of them is meant), at one that no row has, and where it would come back to a key it has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import codes
from corvane.sources import store


def ways_up(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """For each key that one row has: key, ``way`` (itself, its parent, ...) and ``ended`` (root, missing, ambiguous, cycle)."""
    keys = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(parent).alias("parent"))
    keys = store.stored(keys, "keys")
    # what kind of key a parent is, is found out once
    kind = keys.select(F.col("key").alias("parent"), F.when(F.col("n") > 1, "ambiguous").otherwise("known").alias("_kind"))
    first = keys.where("n = 1").join(kind, "parent", "left")
    ended = F.when(F.col("parent").isNull(), "root").when(F.col("parent") == F.col("key"), "cycle").when(F.col("_kind").isNull(), "missing").when(F.col("_kind") == "ambiguous", "ambiguous")
    ways = store.stored(first.select("key", F.array("key").alias("way"), F.when(ended.isNull(), F.col("parent")).alias("next"), ended.alias("ended")), "ways")
    while not ways.where("next IS NOT NULL").isEmpty():
        onward = ways.select(F.col("key").alias("next"), F.col("way").alias("_way"), F.col("next").alias("_next"), F.col("ended").alias("_ended"))
        both = ways.where("next IS NOT NULL").join(onward, "next")
        whole = both.select("key", F.concat("way", "_way").alias("_all"), "_next", "_ended").withColumn("way", F.array_distinct("_all"))
        again = (F.size("way") < F.size("_all")) | F.coalesce(F.array_contains("way", F.col("_next")), F.lit(False))
        longer = whole.select("key", "way", F.when(~again, F.col("_next")).alias("next"), F.when(again, "cycle").otherwise(F.col("_ended")).alias("ended"))
        ways = store.stored(ways.where("next IS NULL").unionByName(longer), "ways")
    return ways.select("key", "way", "ended")


def with_intros(rows: DataFrame, id_col: str, key: str, parent: str, text: str, cap: int, joint: str = "\n") -> DataFrame:
    """Add ``parent_intro`` (the text of the nearest row above that isn't longer than ``cap``) and ``index_text`` (all such
    texts from the top, then the row's own). Longer texts are passed over; empty ones aren't joined."""
    ways = ways_up(rows, key, parent)
    above = rows.select(F.col(id_col).alias("_id"), F.col(parent).alias("key")).join(ways, "key").select("_id", F.posexplode("way").alias("up", "key"))
    texts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.trim(F.coalesce(text, F.lit("")))).alias("intro"), F.max(F.length(F.coalesce(text, F.lit("")))).alias("size"))
    found = above.join(texts.where(F.col("size") <= cap), "key").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("up", "intro"))).alias("_i"))
    out = rows.join(found, F.col(id_col) == F.col("_id"), "left")
    head = F.filter(F.transform(F.reverse("_i"), lambda x: x["intro"]), lambda x: x != "")
    own = F.coalesce(text, F.lit(""))
    joined = F.when(F.size(head) > 0, F.array_join(F.concat(head, F.array(own)), joint)).otherwise(own)
    return out.withColumn("parent_intro", F.get("_i", F.lit(0))["intro"]).withColumn("index_text", joined).drop("_id", "_i")


def dotted_parents(rows: DataFrame, key: str, parent: str = "parent") -> DataFrame:
    """Add the deepest key above a dotted key (1.2.3: 1.2, else 1) that some row has, so that missing levels are skipped."""
    known = rows.select(F.col(key).alias("_p")).distinct()
    up = known.select(F.col("_p").alias("_k"), F.explode(codes.prefixes(F.col("_p"))).alias("_p")).where("_p <> _k").join(known, "_p")
    best = up.groupBy("_k").agg(F.max_by("_p", F.length("_p")).alias(parent))
    return rows.join(best, F.col(key) == F.col("_k"), "left").drop("_k")


def chains(ways: DataFrame) -> DataFrame:
    """How the ways end: one row for each kind of end and length, with how many keys go that way and the least of them."""
    return ways.groupBy("ended", F.size("way").alias("length")).agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("first_key"))
