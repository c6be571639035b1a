"""Corpus integrity: differences of multisets, tables and editions, logical rows, clauses, near-equal names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with side and how often more; counts only, no row is expanded."""
    cols = left.columns
    counted = left.withColumn("_d", F.lit(1)).unionByName(right.withColumn("_d", F.lit(-1))).groupBy(*cols).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return counted.select(*cols, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").alias("times"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that are added, removed or changed, with the names of the changed columns. Repeated keys are an error."""
    for name, df in (("old", old), ("new", new)):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated keys in the {name} table")
    a = old.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in values])
    b = new.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in values])
    both = a.join(b, key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), c) for c in values]))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differs) > 0, "changed")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(differs, ",")).alias("columns")).where("status IS NOT NULL")


def zipped(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Pair the i-th row of each group on both sides; ``whole`` is false where their numbers of rows differ."""
    w = Window.partitionBy(group)
    number = lambda df, name: df.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn(f"_n_{name}", F.count(F.lit(1)).over(w))
    both = number(left, "l").join(number(right, "r").withColumnRenamed(order, f"{order}_right"), [group, "place"], "full_outer")
    return both.withColumn("whole", F.col("_n_l").eqNullSafe(F.col("_n_r"))).drop("_n_l", "_n_r")


def logical_rows(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Join physical lines to logical rows: a row ends with a bar; a line that starts with a code starts a row."""
    w = Window.partitionBy(doc).orderBy(order)
    ends = F.col(line).rlike(r"\|\s*$")
    starts = F.col(line).rlike(r"^\s*\d+(\.\d+)+") | F.coalesce(F.lag(ends).over(w), F.lit(True))
    rows = lines.withColumn("_s", starts.cast("int")).withColumn("row_no", F.sum("_s").over(w))
    per = rows.groupBy(doc, "row_no").agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    return per.select(doc, "row_no", F.size("_l").cast("bigint").alias("n_lines"), F.array_join(F.transform("_l", lambda x: F.trim(x[line])), " ").alias("row_text"))


def filled_forward(lines: DataFrame, doc: str, order: str, header: str) -> DataFrame:
    """Carry the last header (null where a line is none) to the lines after it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(header, F.last(header, ignorenulls=True).over(w))


def clauses(lines: DataFrame, doc: str, order: str, line: str, pattern: str = r"^(\d+(?:\.\d+)*)[.)]\s+") -> DataFrame:
    """Cut numbered text into clauses: number and joined text of each; lines before the first number are clause 0.

    The pattern's first group is the number, so that one function serves documents of different form.
    """
    found = F.regexp_extract(line, pattern, 1)
    marked = lines.withColumn("_p", F.when(found != "", found))
    w = Window.partitionBy(doc).orderBy(order)
    marked = marked.withColumn("clause_no", F.sum(F.col("_p").isNotNull().cast("int")).over(w))
    per = marked.groupBy(doc, "clause_no").agg(F.max("_p").alias("point"), F.array_sort(F.collect_list(F.struct(order, line))).alias("_l"))
    return per.select(doc, "clause_no", F.coalesce("point", F.lit("0")).alias("point"), F.array_join(F.transform("_l", lambda x: x[line]), "\n").alias("clause"))


def near_prefixes(rows: DataFrame, group: str, text: str, shortest: int) -> DataFrame:
    """Pairs of different texts of a group of which one begins with the other (of ``shortest`` characters or more).

    The texts of a group in order have such pairs in runs: an equi-join on exploded prefixes finds them without
    comparing all pairs.
    """
    texts = rows.select(group, text).distinct().where(F.length(text) >= shortest)
    cut = texts.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(shortest), F.length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))))
    return texts.select(group, F.col(text).alias("shorter")).join(cut.withColumnRenamed("_p", "shorter"), [group, "shorter"]).where(F.col(text) != F.col("shorter")).select(group, "shorter", F.col(text).alias("longer"))


def upserted(old: DataFrame, new: DataFrame, key: str, scope: str) -> DataFrame:
    """The table after a refresh: rows of the scopes that ``new`` holds are replaced as a whole, other rows stay.

    A key may occur in several scopes; of rows with one scope and key the least stays. A null scope is a scope.
    """
    scopes = new.select(F.col(scope).alias("_scope")).distinct()
    kept = old.join(scopes, F.col(scope).eqNullSafe(F.col("_scope")), "left_anti")
    first = F.row_number().over(Window.partitionBy(scope, key).orderBy(*old.columns))
    return kept.unionByName(new.select(*old.columns).withColumn("_rn", first).where("_rn = 1").drop("_rn"))
