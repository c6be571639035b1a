"""Work that must not grow with the square of a group: rows that joins make, counted in the executed plans."""

from corvane.plans import codes
from tests.compare import oracle, rows

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def most_joined(df) -> int:
    """The largest number of rows that a join of the query made. Planned once, as adaptive plans drop joins that turn out empty."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df.collect()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        if "Join" in plan.nodeName():
            yield plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def parts(spark, path, data) -> str:
    spark.createDataFrame(data, PART).write.parquet(f"{path}/part.parquet")
    return str(path)


def same_as_sql(df, name, path) -> bool:
    rel = oracle(path).sql(codes.QUERIES[name][1])
    return rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_threshold_lookup_of_one_code(spark, tmp_path):
    path = parts(spark, tmp_path, [(3 * i, f"name {i % 40}", "Brand#7", "LARGE", 1, float(i)) for i in range(600)])
    df = codes.threshold_lookup(spark, path)
    assert most_joined(df) <= 3 * 600 and same_as_sql(df, "threshold_lookup", path)


def test_code_search_of_one_type(spark, tmp_path):
    """Many parts of few codes, prices that tie after rounding and some that are missing."""
    price = lambda i: None if i % 97 == 0 else 900.0 + i % 7 + i % 5 * 0.00002
    path = parts(spark, tmp_path, [(i, "name", f"Brand#{1 + i % 2}", "LARGE", 1 + i % 3, price(i)) for i in range(1200)])
    df = codes.code_search(spark, path)
    assert most_joined(df) <= 60 * 120 and same_as_sql(df, "code_search", path)


def test_code_search_of_lone_codes(spark, tmp_path):
    """Codes of one part or none, so that the tiers above and the type fill the answers."""
    path = parts(spark, tmp_path, [(i, "name", f"Brand#{1 + i % 25}", f"T{i % 2}", 1 + i * 7 % 50, 900.0 + i % 40 / 4) for i in range(700)])
    assert same_as_sql(codes.code_search(spark, path), "code_search", path)


def test_target_selection_of_one_code(spark, tmp_path):
    path = parts(spark, tmp_path, [(i, "name", "Brand#1", "LARGE", 1 + i % 2, 900.0 + i % 7) for i in range(900)])
    df = codes.target_selection(spark, path)
    assert most_joined(df) <= 45 * 120 and same_as_sql(df, "target_selection", path)


def shuffled_rows(df) -> int:
    """Rows that the exchanges of the query wrote."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df.collect()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        if plan.nodeName() == "Exchange":
            yield plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_target_selection_orders_asked_types_only(spark, tmp_path):
    """Parts whose queries are all answered by code: the parts of their type are not put in order."""
    path = parts(spark, tmp_path, [(i, "name", "Brand#1", "LARGE", 1 + i % 2, 900.0 + i) for i in range(900)])
    df = codes.target_selection(spark, path)
    assert shuffled_rows(df) <= 6 * 900 and same_as_sql(df, "target_selection", path)
