"""Queries over files and calls outside of tables, with their SQL: workbooks, manifests, clients with a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import calls
from corvane.sources import formats, sinks, store
from corvane.sources.tables import table


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a workbook for each market segment with a sheet for each nation, and read back by a data source."""
    formats.register(spark)
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    fields = F.posexplode(F.array(F.col("c_name"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")))
    cells = people.select(F.col("c_mktsegment").alias("workbook"), F.col("n_name").alias("sheet"), (F.col("c_custkey") % 1_000_000 + 1).cast("int").alias("row"), fields.alias("col", "text")).withColumn("col", F.col("col") + 1)
    path = store.new_path(spark, "workbooks")
    sinks.write_workbooks(cells, path)
    read = spark.read.format("corvane_xlsx").load(path)
    rows = read.groupBy("path", "sheet", "row").agg(F.max(F.when(F.col("col") == "A", F.col("text"))).alias("name"), F.max(F.when(F.col("col") == "B", F.col("text"))).alias("balance"))
    return rows.select(F.regexp_extract("path", "([^/]*)[.]xlsx$", 1).alias("segment"), F.col("sheet").alias("nation"), "row", "name", "balance")


WORKBOOK_SQL = """SELECT c_mktsegment AS segment, n_name AS nation, (c_custkey % 1000000 + 1)::INTEGER AS row, c_name AS name, c_acctbal::DECIMAL(12,2)::VARCHAR AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _measure() -> Callable[[list], list]:
    """Stands for a model: the length of a text and how often it has an e."""
    return lambda texts: [[len(t), t.count("e")] for t in texts]


def called_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with what a client says of its text; half of the conversations are asked first, the rest finds them cached."""
    turns, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), store.new_path(spark, "calls")
    calls.called(turns.where("conv_id % 2 = 0"), "text", _measure, "array<bigint>", path)
    out = calls.called(turns, "text", _measure, "array<bigint>", path)
    return out.select("conv_id", "turn", F.get("value", F.lit(0)).alias("n_chars"), F.get("value", F.lit(1)).alias("n_e"), "error")


CALLED_SQL = "SELECT conv_id, turn, length(text) AS n_chars, length(text) - length(replace(text, 'e', '')) AS n_e, NULL::VARCHAR AS error FROM conversations"

QUERIES = {
    "workbook_rows": (workbook_rows, WORKBOOK_SQL),
    "called_texts": (called_texts, CALLED_SQL),
}
