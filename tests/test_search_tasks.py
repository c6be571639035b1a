"""Searches keep the scored pairs of one task in bounds."""

from corvane.operators import lexical, retrieval
from corvane.plans import lists
from corvane.plans import retrieval as plans
from tests.compare import oracle, rows
from tests.test_growth import most_joined
from pyspark.sql import functions as F


def test_scored_pairs_are_dealt_by_document(spark, tmp_path, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat('word w', id % 7, ' x', id % 11)").alias("text"), F.lit("s").alias("scope"))
    asked = spark.range(20).select(F.col("id").alias("item_id"), F.expr("concat('word w', id % 7)").alias("text"))
    index = lexical.Index(spark, str(tmp_path / "index"), buckets=2)
    index.refresh(docs)
    plain = {(r[0], r[1]): round(r[2], 9) for r in retrieval.bm25(docs, asked, "doc_id", "item_id").collect()}
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    for scored in (retrieval.bm25(docs, asked, "doc_id", "item_id"), index.bm25(asked, "item_id")):
        assert scored.rdd.getNumPartitions() == 60  # 300 documents, 20 queries, 100 pairs each
        assert {(r[0], r[1]): round(r[2], 9) for r in scored.collect()} == plain


def firsts(scored, k):
    best = retrieval.top_k(scored.withColumn("score", F.round("score", 6)), "item_id", [F.desc("score"), F.asc("doc_id")], k)
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in best.collect())


def test_best_are_the_first_of_all(spark, tmp_path, monkeypatch):
    """Copies that tie, a document and a query without terms, blocks and tiles of a few rows, documents in groups; no joined pairs."""
    text = F.expr("CASE WHEN id = 5 THEN NULL WHEN id % 4 = 0 THEN 'copy word w1' ELSE concat('word w', id % 7, ' x', id % 11, ' word y', id) END")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 3).cast("string").alias("scope"))
    asked = spark.range(20).select(F.col("id").alias("item_id"), F.expr("CASE WHEN id = 3 THEN '' ELSE concat('word w', id % 7, ' y', id, ' copy') END").alias("text"))
    index = lexical.Index(spark, str(tmp_path / "index"), buckets=2)
    index.refresh(docs)
    plain = retrieval.bm25(docs, asked, "doc_id", "item_id")
    kinds = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("g"))
    odd = lambda df: firsts(df.where("doc_id % 2 = 1"), 4)
    want, want_odd = firsts(plain, 4), odd(plain)
    for rows, cells, tile in ((500_000, 2_000_000, 512), (7, 30, 2)):
        monkeypatch.setattr(retrieval, "ROWS", rows)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "DOCS", tile)
        monkeypatch.setattr(retrieval, "TERMS", tile)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if rows == 7 else 10_000)
        best = retrieval.bm25(docs, asked, "doc_id", "item_id", best=4)
        grouped = index.bm25(asked, "item_id", best=4, groups=kinds)
        assert firsts(best, 4) == firsts(index.bm25(asked, "item_id", best=4), 4) == firsts(grouped, 4) == want and odd(grouped) == want_odd
        assert rows == 7 or best.count() <= 20 * 4 * best.rdd.getNumPartitions() < plain.count()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
    assert firsts(retrieval.bm25(docs, asked, "doc_id", "item_id", best=4), 4) == want


def corpus(spark, path) -> str:
    """200 documents and 30 passages that all share five words: 1,000 postings, 30,000 of them with each passage."""
    text = F.expr("concat('common words of all texts ', repeat(concat('w', id % 9, ' '), cast(1 + id % 5 AS int)))")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), text.alias("text"), F.expr("CASE WHEN id % 4 = 3 THEN 'fr' ELSE 'de' END").alias("lang"))
    # the subject's source and the long documents are few and not among the best
    source = F.expr("CASE WHEN id > 194 THEN 'src0' WHEN id = 7 THEN NULL ELSE concat('src', 1 + id % 4) END")
    docs.withColumns({"source": F.expr("NULL"), "n_chars": F.when(F.col("doc_id") == 190, 3000).otherwise(100).cast("bigint")}).withColumn("id", F.col("doc_id")).withColumn("source", source).drop("id").write.parquet(f"{path}/documents.parquet")
    spark.range(30).select(F.col("id").alias("item_id"), F.expr("concat('all common texts of words w', id % 9)").alias("text")).write.parquet(f"{path}/benchmark.parquet")
    vector = F.expr("transform(sequence(1, 64), x -> cast(sin(x * (id + 1)) AS float))")
    spark.range(200).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def held_to_sql(spark, path, query, sql):
    df = query(spark, path)
    assert most_joined(df) <= 4000
    rel = oracle(path).sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_rules_window_joins_no_pairs(spark, tmp_path):
    held_to_sql(spark, corpus(spark, tmp_path), lists.rules_window, lists.RULES_SQL)


def test_filtered_hybrid_joins_no_pairs(spark, tmp_path):
    held_to_sql(spark, corpus(spark, tmp_path), plans.filtered_hybrid, plans.FILTERED_SQL)


def test_refreshed_index_joins_no_pairs(spark, tmp_path):
    held_to_sql(spark, corpus(spark, tmp_path), plans.refreshed_index, plans.BM25_SQL)


def test_stemmed_search_joins_no_pairs(spark, tmp_path):
    path = corpus(spark, tmp_path)
    df = plans.stemmed_search(spark, path)
    assert most_joined(df) <= 4000
    docs, asked = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()) == firsts(retrieval.bm25(docs, asked, "doc_id", "item_id", stem="english"), 5)


def scanned_rows(df) -> int:
    """Rows that the scans of the query's plan gave; what is read again from a shuffle has no scan."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df.collect()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        if plan.nodeName().startswith("Scan parquet"):
            yield plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_stemmed_search_cuts_texts_once_for_scores(spark, tmp_path):
    """The corpus' counts, the terms' and the weights come from one reading of the 200 documents; the distinct words are stored."""
    path = corpus(spark, tmp_path)
    for query in (plans.stemmed_search, plans.bm25_topk):
        assert 200 <= scanned_rows(query(spark, path)) < 300


def test_filtered_hybrid_reads_lists(spark, tmp_path, monkeypatch):
    """An index of lists of postings, made in blocks of a few tokens, gives the results of the SQL."""
    for name, value in (("BLOCK_TOKENS", 50), ("LIST", 3), ("PART", 5000)):
        monkeypatch.setattr(lexical, name, value)
    held_to_sql(spark, corpus(spark, tmp_path), plans.filtered_hybrid, plans.FILTERED_SQL)
