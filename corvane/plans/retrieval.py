"""Retrieval queries over documents, benchmark passages and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import lexical
from corvane.operators import retrieval as R
from corvane.sources import store
from corvane.sources.tables import table

TOK = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{Nd}}]+'), lambda x: length(x) > 1)"

BM25_CTE = f"""
q_terms AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
d_words AS (SELECT doc_id, lang, source, {TOK.format('text')} AS w FROM documents),
sizes AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d_words),
d_terms AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d_words) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM d_terms GROUP BY term),
bm AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM q_terms JOIN d_terms USING (term) JOIN dfs USING (term), sizes GROUP BY item_id, doc_id)
"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every benchmark passage by BM25."""
    scored = R.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", best=5)
    best = R.top_k(scored.withColumn("score", F.round("score", 6)), "item_id", [F.desc("score"), F.asc("doc_id")], 5)
    return best.select("item_id", "doc_id", "score", "rank")


BM25_SQL = f"""WITH {BM25_CTE} SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 5"""


def _first_five(scored: DataFrame) -> DataFrame:
    best = R.top_k(scored.withColumn("score", F.round("score", 6)), "item_id", [F.desc("score"), F.asc("doc_id")], 5)
    return best.select("item_id", "doc_id", "score", "rank")


def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stored index of the documents."""
    index = lexical.of_table(table(spark, sf_dir, "documents"), scope="source")
    return _first_five(index.bm25(table(spark, sf_dir, "benchmark"), "item_id", best=5))


def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that held older texts of two sources (their first halves, and a source of copies that is gone
    now), after both were refreshed and one of the refreshes came twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("scope"))
    late = F.col("scope").isin("src3", "src4")
    older = docs.withColumn("text", F.when(late, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text")))
    index = lexical.Index(spark, store.new_path(spark, "lexical"), buckets=4)
    index.refresh(older.unionByName(docs.where(late).withColumn("scope", F.lit("copies"))))
    index.refresh(docs.where("scope = 'src3'"), gone=["copies"])
    index.refresh(docs.where(late))
    index.refresh(docs.where("scope = 'src3'"))
    return _first_five(index.bm25(table(spark, sf_dir, "benchmark"), "item_id", best=5))


def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every benchmark passage by BM25 over English stems (no SQL: DuckDB has no stems here)."""
    scored = R.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", stem="english", best=5)
    best = R.top_k(scored.withColumn("score", F.round("score", 6)), "item_id", [F.desc("score"), F.asc("doc_id")], 5)
    return best.select("item_id", "doc_id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"), "label")


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.knn(_vectors(spark, sf_dir, "query_id").where("query_id % 20 = 0"), _vectors(spark, sf_dir, "item_id"), k)


KNN_CTE = """
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, d.label, q.label AS query_label, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
"""


def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector."""
    return _knn(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


KNN_SQL = f"WITH {KNN_CTE} SELECT query_id, item_id, round(score, 6) AS score, rank FROM near WHERE rank <= 10"


def ann_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector from an inverted file at a recall of 0.99 (no SQL: the cells decide)."""
    return R.knn(_vectors(spark, sf_dir, "query_id").where("query_id % 20 = 0"), _vectors(spark, sf_dir, "item_id"), 10, exact=False).withColumn("score", F.round("score", 6))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours an exact search finds, and whether the inverted file has at least 95 % of them with equal scores."""
    exact, near = dense_knn(spark, sf_dir), ann_knn(spark, sf_dir)
    both = exact.join(near.select("query_id", "item_id", F.col("score").alias("near")), ["query_id", "item_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"), (F.avg(F.coalesce(F.col("near") == F.col("score"), F.lit(False)).cast("int")) >= 0.95).alias("reached"))


RECALL_SQL = f"WITH {KNN_CTE} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS reached FROM near WHERE rank <= 10"


def dense_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeness of the nearest other vector, and whether it lies under a floor for relevance."""
    best = _knn(spark, sf_dir, 2).where("item_id <> query_id").groupBy("query_id").agg(F.max("score").alias("top1"))
    return best.select("query_id", F.round("top1", 6).alias("top1"), (F.col("top1") < 0.82).alias("low_relevance"))


TOP1_SQL = f"WITH {KNN_CTE} SELECT query_id, round(max(score), 6) AS top1, max(score) < 0.82 AS low_relevance FROM near WHERE item_id <> query_id AND rank <= 2 GROUP BY query_id"


def _halves(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """Two ranked lists for each query: by the first and by the second half of the vectors, rounded so that ties occur."""
    lists = None
    for name, start in (("first", 1), ("second", 33)):
        cut = lambda df: df.withColumn("vector", F.slice("vector", start, 32))  # noqa: B023, E731
        one = R.knn(cut(_vectors(spark, sf_dir, "query_id").where("query_id % 20 = 0")), cut(_vectors(spark, sf_dir, "item_id")), depth)
        one = one.select("query_id", F.lit(name).alias("list_id"), "item_id", F.round("score", 2).alias("score"))
        lists = one if lists is None else lists.union(one)
    return lists


HALVES_CTE = """
both_halves AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, l AS list_id, round(CASE WHEN l = 'first' THEN list_dot_product(q.embedding[1:32]::DOUBLE[], d.embedding[1:32]::DOUBLE[]) ELSE list_dot_product(q.embedding[33:64]::DOUBLE[], d.embedding[33:64]::DOUBLE[]) END, 9) AS score
  FROM embeddings q, embeddings d, (VALUES ('first'), ('second')) t(l) WHERE q.vec_id % 20 = 0),
lists AS (SELECT query_id, list_id, item_id, round(score, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, item_id) AS rank FROM both_halves) WHERE rank <= 20),
shares AS (SELECT query_id, list_id, item_id, score, 1.0::DOUBLE / (1 + row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, item_id)) AS s FROM lists),
tied AS (SELECT *, avg(s) OVER (PARTITION BY query_id, list_id, score) AS share FROM shares),
fused AS (SELECT query_id, item_id, round(sum(share), 9) AS score FROM tied GROUP BY ALL),
fused_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fused)
"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-aware reciprocal rank fusion of two vector lists."""
    return R.fused(_halves(spark, sf_dir, 20), 10).withColumn("score", F.round("score", 6))


RRF_SQL = f"WITH {HALVES_CTE} SELECT query_id, item_id, round(score, 6) AS score, rank FROM fused_rank WHERE rank <= 10"


def _hybrid_lists(spark: SparkSession, sf_dir: str, depth: int, keep: str) -> DataFrame:
    """BM25 and vector lists of the benchmark passages over the documents that ``keep`` holds for.

    A document's vector is the embedding with its id, a passage's the one with the passage's id.
    """
    all_docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    docs = all_docs.where(keep)
    sparse = lexical.of_table(all_docs, scope="source").bm25(passages, "item_id", keep=None if keep == "true" else docs.select("doc_id"), best=depth, digits=9)
    sparse = sparse.select(F.col("item_id").alias("query_id"), F.lit("sparse").alias("list_id"), F.col("doc_id").alias("item_id"), F.round("score", 9).alias("score"))
    sparse = R.top_k(sparse, "query_id", [F.desc("score"), F.asc("item_id")], depth).drop("rank")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.join(passages.select(F.col("item_id").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "query_id")
    items = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "item_id")
    dense = R.knn(asked, items, depth).select("query_id", F.lit("dense").alias("list_id"), "item_id", "score")
    return sparse.unionByName(dense)


def _hybrid_cte(keep: str) -> str:
    return f"""{BM25_CTE},
kept AS (SELECT doc_id FROM documents WHERE {keep}),
sparse AS (SELECT item_id AS query_id, 'sparse' AS list_id, doc_id AS item_id, round(score, 9) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM kept)),
dense AS (SELECT q.vec_id AS query_id, 'dense' AS list_id, d.vec_id AS item_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM kept)),
lists AS (SELECT query_id, list_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, item_id) AS rank FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense)) WHERE rank <= 20),
shares AS (SELECT *, 1.0::DOUBLE / (1 + row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, item_id)) AS s FROM lists),
tied AS (SELECT *, avg(s) OVER (PARTITION BY query_id, list_id, score) AS share FROM shares),
fused AS (SELECT query_id, item_id, round(sum(share), 9) AS score FROM tied GROUP BY ALL),
fused_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fused)"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and vectors, fused."""
    return R.fused(_hybrid_lists(spark, sf_dir, 20, "true"), 10).withColumn("score", F.round("score", 6))


HYBRID_SQL = f"WITH {_hybrid_cte('true')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM fused_rank WHERE rank <= 10"


def filtered_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over the documents of one language; document counts stay those of the corpus."""
    return R.fused(_hybrid_lists(spark, sf_dir, 20, "lang = 'fr' AND NOT source <=> 'src3'"), 10).withColumn("score", F.round("score", 6))


FILTERED_SQL = f"WITH {_hybrid_cte(chr(39).join(['lang = ', 'fr', ' AND source IS DISTINCT FROM ', 'src3', '']))} SELECT query_id, item_id, round(score, 6) AS score, rank FROM fused_rank WHERE rank <= 10"


def rescored_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two differently filtered searches, ranked again together on one scale."""
    one = R.fused(_hybrid_lists(spark, sf_dir, 20, "lang = 'fr'"), 5)
    two = R.fused(_hybrid_lists(spark, sf_dir, 20, "lang = 'de'"), 5)
    wanted = one.select("query_id", "item_id").union(two.select("query_id", "item_id")).distinct()
    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = lexical.of_table(docs, scope="source")
    sparse = index.bm25(passages, "item_id", keep=wanted.select(F.col("item_id").alias("doc_id"))).select(F.col("item_id").alias("query_id"), F.lit("sparse").alias("list_id"), F.col("doc_id").alias("item_id"), F.round("score", 9).alias("score"))
    vectors = table(spark, sf_dir, "embeddings")
    pair = wanted.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("b")), "item_id")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    dense = pair.select("query_id", F.lit("dense").alias("list_id"), "item_id", F.round(dot, 9).alias("score"))
    both = sparse.join(wanted, ["query_id", "item_id"], "left_semi").select("query_id", "list_id", "item_id", "score").union(dense)
    return R.fused(both, 10).withColumn("score", F.round("score", 6))


def _rescore_sql() -> str:
    search = lambda keep: f"SELECT query_id, item_id FROM (WITH {_hybrid_cte(keep)} SELECT * FROM fused_rank WHERE rank <= 5)"
    return f"""WITH wanted AS ({search("lang = 'fr'")} UNION {search("lang = 'de'")}),
{BM25_CTE},
lists AS (SELECT item_id AS query_id, 'sparse' AS list_id, doc_id AS item_id, round(score, 9) AS score FROM bm WHERE (item_id, doc_id) IN (SELECT (query_id, item_id) FROM wanted)
  UNION ALL SELECT query_id, 'dense', item_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) FROM wanted JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = item_id),
shares AS (SELECT *, 1.0::DOUBLE / (1 + row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, item_id)) AS s FROM lists),
tied AS (SELECT *, avg(s) OVER (PARTITION BY query_id, list_id, score) AS share FROM shares),
fused AS (SELECT query_id, item_id, round(sum(share), 9) AS score FROM tied GROUP BY ALL)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fused) WHERE rank <= 10"""


def section_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels voted for by the nearest vectors, with a penalty for large labels."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("section_size"))
    votes = R.voted(_knn(spark, sf_dir, 20).join(labels, "item_id"), "label", sizes, 0.5)
    return votes.select("query_id", "label", F.round("score", 9).alias("score"))


VOTE_SQL = f"""WITH {KNN_CTE}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT query_id, label, round(sum(1.0::DOUBLE / (60 + rank)) / pow(max(n), 0.5), 9) AS score FROM near JOIN sizes USING (label) WHERE rank <= 20 GROUP BY query_id, label"""


def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve places for each passage: three for the main source, two for others in turn, then by rank; the main source's
    rows come first."""
    scored = lexical.of_table(table(spark, sf_dir, "documents"), scope="source").bm25(table(spark, sf_dir, "benchmark"), "item_id", best=40)
    scored = scored.select(F.col("item_id").alias("query_id"), "doc_id", F.round("score", 6).alias("score"))
    ranked = R.top_k(scored, "query_id", [F.desc("score"), F.asc("doc_id")], 40).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    quota = F.when(F.col("source") == "src0", 3).when(F.col("source") == "src1", 0).otherwise(2)
    own = F.coalesce(F.col("source") == "src0", F.lit(False))
    return R.quota_window(ranked, "source", quota, 12, [~own, F.col("source")], [~own]).select("query_id", "doc_id", "source", "rank", "place")


QUOTA_SQL = f"""WITH {BM25_CTE}, ranked AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
pool AS (SELECT r.*, source FROM ranked r JOIN documents USING (doc_id) WHERE rank <= 40),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn FROM pool),
chosen AS (SELECT *, coalesce(turn <= CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 0 ELSE 2 END, false) AS chosen FROM turns),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chosen DESC, CASE WHEN chosen THEN turn END NULLS FIRST, CASE WHEN chosen THEN coalesce(source <> 'src0', true) END NULLS FIRST, CASE WHEN chosen THEN source END NULLS FIRST, rank) AS choice FROM chosen) WHERE choice <= 12)
SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(source <> 'src0', true), rank) AS place FROM first"""


def name_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names share words with a part's own type and name: by matched words, then summed idf."""
    part = table(spark, sf_dir, "part")
    names = R.with_class(part, tokens(F.col("p_name"))).select(F.col("p_partkey").alias("code"), "cls", F.lit(0).alias("grp"))
    asked = R.with_class(part.where("p_partkey % 20 = 0"), tokens(F.concat_ws(" ", "p_name", "p_type")), "qcls").select(F.col("p_partkey").alias("query_id"), "qcls", F.lit(0).alias("grp"))
    found = R.best_in_groups(asked, names, R.class_scores(asked, names), "code", ["matched", "score"], 5)
    both = asked.join(found, ["qcls", "grp"])
    return R.top_k(both, "query_id", [F.desc("matched"), F.desc("score"), F.asc("code")], 5).select("query_id", "code", "matched", "score", "rank")


SUGGEST_SQL = f"""WITH names AS (SELECT p_partkey AS code, unnest(list_distinct({TOK.format('p_name')})) AS term FROM part),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM part) / count(*)::DOUBLE) AS idf FROM names GROUP BY term),
asked AS (SELECT p_partkey AS query_id, unnest(list_distinct({TOK.format("concat_ws(' ', p_name, p_type)")})) AS term FROM part WHERE p_partkey % 20 = 0),
found AS (SELECT query_id, code, count(*) AS matched, round(sum(idf), 6) AS score FROM asked JOIN idf USING (term) JOIN names USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, code) AS rank FROM found) WHERE rank <= 5"""


def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases near a query: the fused list, kept where the plain cosine reaches a floor or the label is the query's own."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    fused = R.fused(_halves(spark, sf_dir, 20), 20)
    dense = _knn(spark, sf_dir, 64).select("query_id", "item_id", F.col("score").alias("cosine"))
    rows = fused.join(dense, ["query_id", "item_id"], "left").join(labels.toDF("item_id", "label"), "item_id").join(labels.toDF("query_id", "query_label"), "query_id")
    kept = rows.where("cosine >= 0.84 OR label = query_label")
    return R.top_k(kept, "query_id", [F.desc("score"), F.asc("item_id")], 5, "place").select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "place")


CASE_SQL = f"""WITH {KNN_CTE}, {HALVES_CTE}, labels AS (SELECT vec_id, label FROM embeddings),
rows_ AS (SELECT f.query_id, f.item_id, f.score, n.score AS cosine, l.label, q.label AS query_label FROM fused_rank f LEFT JOIN (SELECT * FROM near WHERE rank <= 64) n USING (query_id, item_id) JOIN labels l ON l.vec_id = f.item_id JOIN labels q ON q.vec_id = f.query_id WHERE f.rank <= 20),
kept AS (SELECT * FROM rows_ WHERE cosine >= 0.84 OR label = query_label)
SELECT query_id, item_id, round(cosine, 6) AS cosine, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM kept) WHERE place <= 5"""


def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's order laid over the search's; here it names the items of even id, largest first."""
    ranked = _knn(spark, sf_dir, 10)
    places = ranked.where("item_id % 2 = 0").select("query_id", "item_id", (-F.col("item_id")).alias("new_place"))
    return R.reranked(ranked, places).select("query_id", "item_id", "rank", "new_rank")


RERANK_SQL = f"WITH {KNN_CTE} SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item_id % 2 = 0 THEN -item_id ELSE 1000000 + rank END, rank) AS new_rank FROM near WHERE rank <= 10"


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts that still need a vector: those whose digest no passage of the benchmark has."""
    known = table(spark, sf_dir, "benchmark").select(F.sha1("text").alias("digest")).distinct()
    texts = table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"))
    return texts.join(known, "digest", "left_anti")


CACHE_SQL = "SELECT sha1(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM benchmark) GROUP BY 1"


def low_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries flagged as off the subject: a low best cosine, or all three first labels foreign to the query's."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    near = _knn(spark, sf_dir, 4).where("item_id <> query_id").join(labels, "item_id").join(labels.toDF("query_id", "query_label"), "query_id")
    near = R.top_k(near, "query_id", [F.asc("rank")], 3, "place")
    per = near.groupBy("query_id").agg(F.max("score").alias("top1"), F.bool_and(F.col("label") != F.col("query_label")).alias("out_of_scope"))
    return per.select("query_id", F.round("top1", 6).alias("top1"), "out_of_scope", ((F.col("top1") < 0.82) | F.col("out_of_scope")).alias("flagged"))


LOW_SQL = f"""WITH {KNN_CTE}, three AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM near WHERE item_id <> query_id AND rank <= 4)
SELECT query_id, round(max(score), 6) AS top1, bool_and(label <> query_label) AS out_of_scope, max(score) < 0.82 OR bool_and(label <> query_label) AS flagged FROM three WHERE place <= 3 GROUP BY query_id"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_SQL),
    "indexed_bm25": (indexed_bm25, BM25_SQL),
    "refreshed_index": (refreshed_index, BM25_SQL),
    "stemmed_search": (stemmed_search, None),
    "dense_knn": (dense_knn, KNN_SQL),
    "ann_knn": (ann_knn, None),
    "ann_recall": (ann_recall, RECALL_SQL),
    "dense_top1": (dense_top1, TOP1_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "filtered_hybrid": (filtered_hybrid, FILTERED_SQL),
    "rescored_union": (rescored_union, _rescore_sql()),
    "section_vote": (section_vote, VOTE_SQL),
    "quota_window": (quota_window, QUOTA_SQL),
    "name_suggest": (name_suggest, SUGGEST_SQL),
    "case_search": (case_search, CASE_SQL),
    "rerank_merge": (rerank_merge, RERANK_SQL),
    "embedding_cache": (embedding_cache, CACHE_SQL),
    "low_relevance": (low_relevance, LOW_SQL),
}
