"""Evaluation queries over the neighbours of embeddings and over documents, with their SQL.

A vector's wanted item is the first of its neighbours with its own label; sections are labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import dialog as D
from corvane.functions import facts as S
from corvane.operators import evaluation as E
from corvane.plans.retrieval import KNN_CTE, _knn
from corvane.sources.tables import table


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _knn(spark, sf_dir, 11).where("item_id <> query_id").withColumn("rank", F.col("rank") - 1)
    near = near.join(labels.toDF("item_id", "label"), "item_id").join(labels.toDF("query_id", "query_label"), "query_id")
    per = E.first_rank(near, F.col("label") == F.col("query_label"))
    return per.join(labels.toDF("query_id", "label"), "query_id")


RANKS = f"""{KNN_CTE}, ranks AS (SELECT query_id, query_label AS label, min(CASE WHEN label = query_label THEN rank - 1 END) AS rank FROM near WHERE rank <= 11 AND item_id <> query_id GROUP BY 1, 2)"""


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: recall at 1, 3 and 10, mean reciprocal rank, and how many are never found."""
    r = F.col("rank")
    return _ranks(spark, sf_dir).agg(F.round(E.recall_at(r, 1), 6).alias("recall_1"), F.round(E.recall_at(r, 3), 6).alias("recall_3"), F.round(E.recall_at(r, 10), 6).alias("recall_10"), F.round(E.mrr(r), 6).alias("mrr"), F.count_if(r.isNull()).alias("invisible"))


RECALL_SQL = f"WITH {RANKS} SELECT round(avg(coalesce(rank <= 1, false)::INTEGER), 6) AS recall_1, round(avg(coalesce(rank <= 3, false)::INTEGER), 6) AS recall_3, round(avg(coalesce(rank <= 10, false)::INTEGER), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(*) FILTER (WHERE rank IS NULL) AS invisible FROM ranks"


def recall_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 3 of each label with the Wilson bound, weakest first."""
    per = _ranks(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= 3).alias("found"))
    return per.select("label", "n", "found", F.round(D.wilson(F.col("found"), F.col("n"))[0], 6).alias("low")).orderBy("low", "label")


SECTION_SQL = f"""WITH {RANKS}, p AS (SELECT label, count(*)::DOUBLE AS n, count(*) FILTER (WHERE rank <= 3)::DOUBLE AS k FROM ranks GROUP BY 1), q AS (SELECT *, k / n AS p FROM p)
SELECT label, n::BIGINT AS n, k::BIGINT AS found, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS low FROM q ORDER BY low, label"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose own label is found but not first, by the label that stands first."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = _knn(spark, sf_dir, 2).where("item_id <> query_id").groupBy("query_id").agg(F.min_by("item_id", "rank").alias("item_id")).join(labels.toDF("item_id", "top_label"), "item_id")
    return _ranks(spark, sf_dir).where("rank > 1").join(top, "query_id").groupBy("label", "top_label").agg(F.count(F.lit(1)).alias("n"))


COLLISION_SQL = f"WITH {RANKS}, t AS (SELECT query_id, arg_min(label, rank) AS top_label FROM near WHERE rank <= 2 AND item_id <> query_id GROUP BY 1) SELECT label, top_label, count(*) AS n FROM ranks JOIN t USING (query_id) WHERE rank > 1 GROUP BY 1, 2"


def repeat_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, bounds and half range of the accepted share over five repeats (documents dealt by id)."""
    rows = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("run")).agg(F.avg("quality").alias("share"))
    return rows.agg(F.round(F.avg("share"), 6).alias("mean"), F.round(F.min("share"), 6).alias("low"), F.round(F.max("share"), 6).alias("high"), F.round((F.max("share") - F.min("share")) / 2, 6).alias("half_range"))


SPREAD_SQL = "WITH r AS (SELECT doc_id % 5 AS run, avg(quality) AS share FROM labels GROUP BY 1) SELECT round(avg(share), 6) AS mean, round(min(share), 6) AS low, round(max(share), 6) AS high, round((max(share) - min(share)) / 2, 6) AS half_range FROM r"


def threshold_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False accepts and false flags for a few thresholds of the neighbours' likeness; good pairs have equal labels."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _knn(spark, sf_dir, 10).where("item_id <> query_id").join(labels.toDF("item_id", "label"), "item_id").join(labels.toDF("query_id", "query_label"), "query_id")
    scores = near.select("score", (F.col("label") == F.col("query_label")).alias("good"))
    steps = spark.createDataFrame([(t / 100,) for t in range(20, 60, 5)], "threshold double")
    return E.trade_off(scores, steps, "score", "good")


TRADE_SQL = f"WITH {KNN_CTE} SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE score >= t / 100.0::DOUBLE AND label <> query_label) AS false_accept, count(*) FILTER (WHERE score < t / 100.0::DOUBLE AND label = query_label) AS false_flag FROM near, range(20, 60, 5) r(t) WHERE rank <= 10 AND item_id <> query_id GROUP BY t"


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts name their own section strictly (its word before its number); the texts are made of turns."""
    text = F.concat(F.lit("as section "), F.col("turn") % 4, F.lit(" says, "), F.col("role"))
    section = F.col("conv_id") % 4
    rows = table(spark, sf_dir, "conversations").select(section.alias("section"), F.contains(text, F.concat(F.lit("section "), section, F.lit(" "))).alias("strict"), F.contains(text, section.cast("string")).alias("loose"))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("strict"), F.count_if("loose").alias("loose"))


ATTRIBUTION_SQL = "WITH t AS (SELECT conv_id % 4 AS section, 'as section ' || turn % 4 || ' says, ' || role AS t FROM conversations) SELECT section, count(*) AS n, count(*) FILTER (WHERE contains(t, 'section ' || section || ' ')) AS strict, count(*) FILTER (WHERE contains(t, section::VARCHAR)) AS loose FROM t GROUP BY 1"


def obligatory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct point values of each order's block, largest first, with its threshold and an exception flag."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_quantity").cast("int")), asc=False).alias("points"), F.sum("l_quantity").alias("threshold"), F.bool_or(F.col("l_returnflag") == "R").alias("has_exception"))
    return per.select("l_orderkey", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"), "threshold", "has_exception")


FACTS_SQL = "SELECT l_orderkey, array_to_string(list_reverse_sort(list_distinct(list(l_quantity::INTEGER))), ',') AS points, sum(l_quantity) AS threshold, bool_or(l_returnflag = 'R') AS has_exception FROM lineitem GROUP BY 1"


def population_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: labels in both runs (documents whose id, or whose id less one, is labelled) that differ, and totals."""
    labels = table(spark, sf_dir, "labels")
    old, new = labels.select("doc_id", "toxic"), labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("toxic").alias("toxic_new"))
    return old.join(new, "doc_id").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("toxic") != F.col("toxic_new")).alias("changed"), F.sum("toxic").cast("bigint").alias("old_total"), F.sum("toxic_new").cast("bigint").alias("new_total"))


POPULATION_SQL = "SELECT count(*) AS \"both\", count(*) FILTER (WHERE o.toxic <> n.toxic) AS changed, sum(o.toxic)::BIGINT AS old_total, sum(n.toxic)::BIGINT AS new_total FROM labels o JOIN labels n ON n.doc_id - 1 = o.doc_id"


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language, chosen by a digest of id and seed."""
    return E.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 3, 42)


SAMPLE_SQL = "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('42:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 3"


def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank at which each queried vector finds itself."""
    found = E.first_rank(_knn(spark, sf_dir, 10), F.col("item_id") == F.col("query_id"))
    return found.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


SELF_SQL = f"WITH {KNN_CTE} SELECT rank, count(*) AS n FROM (SELECT query_id, min(CASE WHEN item_id = query_id THEN rank END) AS rank FROM near WHERE rank <= 10 GROUP BY 1) GROUP BY rank"


LICENSE_LINE, MAIL, NUMBER = r"^\s*(?:Released|Licensed) under (?:the )?([^\n]+)$", r"^.*?([A-Za-z0-9.]+@[A-Za-z0-9.]+)", r"([0-9]+(?:[.,][0-9]+)?)"


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's text states: its license line, its first mail address, its numbers (largest first), two marks."""
    # Java's \s holds the vertical tab too
    found = S.facts(F.col("text"), LICENSE_LINE.replace(r"\s", r"[\t\n\f\r ]"), MAIL, NUMBER, {"has_bars": " | ", "is_loud": "!!"})
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", found.alias("f"))
    return rows.select("doc_id", F.col("f.threshold").alias("license"), F.col("f.exception").alias("mail"), F.array_join("f.points", " ").alias("numbers"), "f.has_bars", "f.is_loud")


DOCUMENT_FACTS_SQL = rf"""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '{NUMBER}')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_extract(text, '(?m){LICENSE_LINE}', 1)) AS license, trim(regexp_extract(text, '(?m){MAIL}', 1)) AS mail,
 array_to_string(list_transform(list_reverse_sort(list_transform(n, lambda x: {{'n': replace(x, ',', '.')::DOUBLE, 'x': x}})), lambda p: p.x), ' ') AS numbers, contains(text, ' | ') AS has_bars, contains(text, '!!') AS is_loud FROM d"""


def page_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the article of each page names the title of the page before it in the site's order strictly, or shares a longer word."""
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("text"))
    both = rows.join(rows.select((F.col("page_id") + 1).alias("page_id"), F.col("title").alias("other")), "page_id", "left")
    number = F.col("page_id").cast("string")
    return both.select("page_id", S.attributed(F.col("text"), number, F.col("title")).alias("own"), S.attributed(F.col("text"), number, F.col("other")).alias("others"), S.on_subject(F.col("text"), F.col("other")).alias("loosely"))


PAGE_ATTRIBUTION_SQL = r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS text FROM pages WHERE html IS NOT NULL),
b AS (SELECT p.*, o.title AS other FROM p LEFT JOIN p o ON o.page_id + 1 = p.page_id),
t AS (SELECT page_id, text, lower(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) AS low, lower(trim(regexp_replace(replace(title, chr(160), ' '), '\s+', ' ', 'g'), ' ,;')) AS title, lower(trim(regexp_replace(replace(other, chr(160), ' '), '\s+', ' ', 'g'), ' ,;')) AS other FROM b),
w AS (SELECT *, list_filter(regexp_extract_all(other, '\p{L}+'), lambda x: length(x) >= 6) AS w FROM t)
SELECT page_id, coalesce(title <> '' AND contains(low, title), false) AS own, coalesce(other <> '' AND contains(low, other), false) AS others, coalesce(len(list_filter(w, lambda x: contains(lower(text), x))) > 0, false) AS loosely FROM w"""

QUERIES = {
    "document_facts": (document_facts, DOCUMENT_FACTS_SQL),
    "page_attribution": (page_attribution, PAGE_ATTRIBUTION_SQL),
    "recall_mrr": (recall_mrr, RECALL_SQL),
    "recall_by_section": (recall_by_section, SECTION_SQL),
    "collisions": (collisions, COLLISION_SQL),
    "repeat_spread": (repeat_spread, SPREAD_SQL),
    "threshold_trade": (threshold_trade, TRADE_SQL),
    "attribution": (attribution, ATTRIBUTION_SQL),
    "obligatory_facts": (obligatory_facts, FACTS_SQL),
    "population_compare": (population_compare, POPULATION_SQL),
    "stratified_sample": (stratified_sample, SAMPLE_SQL),
    "self_retrieval": (self_retrieval, SELF_SQL),
}
