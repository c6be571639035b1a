"""The stored inverted file beside the exact search."""

import numpy as np
import pytest

from corvane.operators import neighbours, retrieval

SCHEMA = "item_id bigint, vector array<double>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, size=3000)] + 0.3 * rng.normal(size=(3000, 16))
    return neighbours.unit(x)


def test_recall_and_pruning(spark, tmp_path, vectors):
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    index = neighbours.build(items, str(tmp_path / "index"))
    assert 1 < index.probes(0.95) < len(index.centroids) and index.sizes.sum() == 3000 and index.recall[-1] == 1
    found = neighbours.search(queries, index, 10, recall=0.95)
    exact = retrieval.knn(queries, items, 10)
    got = {(r.query_id, r.item_id, r.score) for r in found.collect()}
    want = {(r.query_id, r.item_id, r.score) for r in exact.collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)
    # one query reads its own cells only
    one = neighbours.search(queries.where("query_id = 40"), index, 10, recall=0.95)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    # the index can be loaded and searched again, and all cells give the exact result
    again = neighbours.search(queries, neighbours.load(spark, index.path), 10, recall=2.0)
    assert {(r.query_id, r.item_id, r.score) for r in again.collect()} == want


def test_few_null_and_repeated_items(spark, tmp_path, vectors):
    rows = [(i, vectors[i].tolist()) for i in range(5)] + [(None, vectors[9].tolist()), (7, None), (3, vectors[3].tolist())]
    items = spark.createDataFrame(rows, SCHEMA)
    queries = items.withColumnRenamed("item_id", "query_id")
    index = neighbours.build(items, str(tmp_path / "few"))
    got = neighbours.search(queries, index, 20).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 6, 1: 6, 2: 6, 3: 12, 4: 6}
    empty = neighbours.build(items.limit(0), str(tmp_path / "none"))
    assert neighbours.search(queries, empty, 3).count() == 0


def test_large_cells_are_split(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERIES", 20)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:800])], SCHEMA)
    queries = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    index = neighbours.build(items, str(tmp_path / "split"))
    got = neighbours.search(queries, index, 5, recall=2.0).select("query_id", "item_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.knn(queries, items, 5).select("query_id", "item_id", "rank").collect()))
