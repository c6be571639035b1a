"""Text guard queries over documents, benchmark passages and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import guards as G
from corvane.functions import text as T
from corvane.plans.retrieval import TOK
from corvane.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal or restricted data in each document that has any, and whether one of them blocks it."""
    rows = _docs(spark, sf_dir).where(F.lower("text").rlike(G.SUSPICIOUS)).select("doc_id", G.sensitive_kinds(F.col("text")).alias("k")).where(F.size("k") > 0)
    return rows.select("doc_id", F.array_join("k", ",").alias("kinds"), F.arrays_overlap("k", F.array(*map(F.lit, G.BLOCKING))).alias("blocking"))


LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INTEGER ELSE CASE WHEN d[i]::INTEGER * 2 > 9 THEN d[i]::INTEGER * 2 - 9 ELSE d[i]::INTEGER * 2 END END)) % 10 = 0"


def _has(kind: str, pattern: str, test: str) -> str:
    return f"{kind} AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{pattern}')), '[^0-9]', '', 'g') AS n FROM documents) x, LATERAL (SELECT n AS d) WHERE {test})"


def _sum_sql(weights: tuple[int, ...], start: int = 0) -> str:
    return "(" + " + ".join(f"{w} * n[{start + i + 1}]::INTEGER" for i, w in enumerate(weights)) + ")"


_NINE = _sum_sql(tuple(range(9, 0, -1)))
PII_SQL = f"""WITH {_has("card", G.CARD, LUHN)},
{_has("snils", G.SNILS, f"{_NINE} % 101 % 100 = n[10:11]::INTEGER AND length(replace(n[1:9], n[1], '')) > 0")},
{_has("inn_person", G.INN_PERSON, f"{_sum_sql(G.INN11)} % 11 % 10 = n[11]::INTEGER AND {_sum_sql(G.INN12)} % 11 % 10 = n[12]::INTEGER")},
f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), '{G.RESTRICTED}') THEN 'restricted' END, CASE WHEN regexp_matches(lower(text), '{G.PASSPORT}') THEN 'passport' END,
 CASE WHEN doc_id IN (FROM snils) THEN 'snils' END, CASE WHEN doc_id IN (FROM inn_person) THEN 'inn_person' END, CASE WHEN doc_id IN (FROM card) THEN 'card' END,
 CASE WHEN regexp_matches(lower(text), '{G.PHONE}') THEN 'phone' END, CASE WHEN regexp_matches(text, '{G.EMAIL}') THEN 'email' END, CASE WHEN regexp_matches(text, '{G.ADDRESS}') THEN 'address' END], lambda x: x IS NOT NULL) AS k FROM documents)
SELECT doc_id, array_to_string(k, ',') AS kinds, list_has_any(k, [{", ".join(f"'{k}'" for k in G.BLOCKING)}]) AS blocking FROM f WHERE len(k) > 0"""


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order numbers, written with ten, eleven and twelve digits, have valid check digits."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 1234567).cast("string"), 12, "5").alias("n"))
    return rows.select("o_orderkey", G.inn_valid(F.substring("n", 1, 10)).alias("ten"), G.inn_valid(F.col("n")).alias("twelve"), G.snils_valid(F.substring("n", 2, 11)).alias("eleven"), G.card_valid(F.concat("n", F.lit("4"))).alias("card"))


CHECK_SQL = f"""WITH r AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + 1234567)::VARCHAR, 12, '5') AS n FROM orders), s AS (SELECT *, n || '4' AS d FROM r)
SELECT o_orderkey, {_sum_sql(G.INN10)} % 11 % 10 = n[10]::INTEGER AS ten, {_sum_sql(G.INN11)} % 11 % 10 = n[11]::INTEGER AND {_sum_sql(G.INN12)} % 11 % 10 = n[12]::INTEGER AS twelve,
 {_sum_sql(tuple(range(9, 0, -1)), 1)} % 101 % 100 = n[11:12]::INTEGER AND length(replace(n[2:10], n[2], '')) > 0 AS eleven, {LUHN} AS card FROM s"""


def ngram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each passage's words and word pairs that each document with any of them has."""
    grams = lambda df: df.withColumn("_w", T.tokens(F.col("text"))).withColumn("g", F.concat("_w", T.ngrams(F.col("_w"), 2)))
    known = grams(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct("g")).alias("gram"))
    own = grams(table(spark, sf_dir, "benchmark")).select("item_id", F.array_distinct("g").alias("g")).select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    hits = own.join(known, "gram").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select("item_id", "doc_id", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("coverage"))


GRAMS_SQL = f"""WITH w AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents), b AS (SELECT item_id, {TOK.format('text')} AS w FROM benchmark),
k AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w), o AS (SELECT item_id, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gs FROM b),
e AS (SELECT item_id, len(gs) AS n, unnest(gs) AS g FROM o)
SELECT item_id, doc_id, count(*) AS hits, round(count(*) / max(n)::DOUBLE, 6) AS coverage FROM e JOIN k USING (g) GROUP BY 1, 2"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up answers: numbers of an event and its neighbours, partly those of a context and a question."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("rate "), n % 7, F.lit(",5 and "), n % 11, F.lit(" points of "), n % 13, F.lit(" and "), n % 7, F.lit(".5")).alias("answer"),
        F.concat(F.lit("table: "), n % 7, F.lit(".5 | "), (n + 3) % 11).alias("context"),
        F.concat(F.lit("is it "), n % 13, F.lit("?")).alias("question"),
    )


ANSWERS = """a AS (SELECT event_id, 'rate ' || event_id % 7 || ',5 and ' || event_id % 11 || ' points of ' || event_id % 13 || ' and ' || event_id % 7 || '.5' AS answer, 'table: ' || event_id % 7 || '.5 | ' || (event_id + 3) % 11 AS context, 'is it ' || event_id % 13 || '?' AS question FROM events)"""
NUM = r"list_transform(regexp_extract_all({0}, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.'))"


def unverified_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of answers that stand nowhere else, and those that only echo the question."""
    a, c, q = F.col("answer"), F.col("context"), F.col("question")
    return _answers(spark, sf_dir).select("event_id", F.array_join(G.unverified(a, c, q), "|").alias("unverified"), F.array_join(G.echoed(a, c, q), "|").alias("echoed"))


UNVERIFIED_SQL = f"""WITH {ANSWERS}, n AS (SELECT event_id, {NUM.format('answer')} AS a, {NUM.format('context')} AS c, {NUM.format('question')} AS q FROM a),
f AS (SELECT event_id, a, c, q, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM n)
SELECT event_id, array_to_string(list_filter(d, lambda x: NOT list_contains(c, x) AND NOT list_contains(q, x)), '|') AS unverified, array_to_string(list_filter(d, lambda x: NOT list_contains(c, x) AND list_contains(q, x)), '|') AS echoed FROM f"""


def foreign_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an answer that belong to other events of its group, less those of its own context."""
    rows = _answers(spark, sf_dir).withColumn("g", F.col("event_id") % 50)
    others = rows.select("g", F.col("event_id").alias("o"), F.explode(T.numbers(F.col("context"))).alias("n"))
    own = rows.select("g", "event_id", F.explode(F.array_except(T.numbers(F.col("answer")), T.numbers(F.col("context")))).alias("n"))
    foreign = others.groupBy("g", "n").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    hit = own.join(foreign, ["g", "n"]).where("low <> event_id OR high <> event_id")
    return hit.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("n")), "|").alias("leaked"))


FOREIGN_SQL = f"""WITH {ANSWERS}, n AS (SELECT event_id, event_id % 50 AS g, {NUM.format('answer')} AS a, {NUM.format('context')} AS c FROM a), o AS (SELECT g, event_id AS o, unnest(c) AS x FROM n), w AS (SELECT event_id, g, unnest(list_filter(a, lambda y: NOT list_contains(c, y))) AS x FROM n)
SELECT event_id, string_agg(DISTINCT x, '|' ORDER BY x) AS leaked FROM w WHERE EXISTS (SELECT 1 FROM o WHERE o.g = w.g AND o.x = w.x AND o.o <> w.event_id) GROUP BY event_id"""


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of each turn by the first rule that fits, and by most hits (none at a tie); counts of both."""
    rules = [("narrow", r"(?i) the .* with "), ("middle", r"(?i) with "), ("wide", r"(?i) (?:der|the|de) ")]
    hits = [("english", r" the "), ("french", r" les? "), ("german", r" d(?:er|ie|as) ")]
    flat = F.regexp_replace("text", "\n", " ")
    rows = table(spark, sf_dir, "conversations").select(G.first_topic(flat, rules).alias("first_topic"), G.best_topic(flat, hits).alias("best_topic"))
    return rows.groupBy("first_topic", "best_topic").agg(F.count(F.lit(1)).alias("n"))


ROUTING_SQL = r"""WITH t AS (SELECT replace(text, chr(10), ' ') AS t FROM conversations), c AS (SELECT t, len(regexp_extract_all(t, ' the ')) AS e, len(regexp_extract_all(t, ' les? ')) AS f, len(regexp_extract_all(t, ' d(?:er|ie|as) ')) AS g FROM t)
SELECT CASE WHEN regexp_matches(t, '(?i) the .* with ') THEN 'narrow' WHEN regexp_matches(t, '(?i) with ') THEN 'middle' WHEN regexp_matches(t, '(?i) (?:der|the|de) ') THEN 'wide' END AS first_topic,
 CASE WHEN e > f AND e > g THEN 'english' WHEN f > e AND f > g THEN 'french' WHEN g > e AND g > f THEN 'german' END AS best_topic, count(*) AS n FROM c GROUP BY 1, 2"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of all documents, with sentence counts and grouped lengths."""
    return _docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), F.size(T.sentences(F.col("text"))).cast("bigint").alias("n_sentences"), T.grouped_digits(F.col("n_chars") * 1000).alias("size"))


def excerpt_sql(text: str, most: int) -> str:
    """The SQL of ``text.excerpt``."""
    line = rf"regexp_replace(l, '{T.REFERENCE}', '', 'g')"
    line = rf"replace(replace({line}, '**', ''), '`', '')"
    line = rf"regexp_replace({line}, '(^|[^\p{{L}}\p{{N}}_])_(.+?)_([^\p{{L}}\p{{N}}_]|$)', '\1\2\3', 'g')"
    line = rf"regexp_replace({line}, '{T.MARKER}', '')"
    lines = rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, T)), lambda x: x <> '' AND NOT starts_with(x, '|'))".replace(", T)", ", concat(' ', chr(9), chr(13)))")
    out = rf"regexp_replace(trim(regexp_replace(array_to_string(list_transform({lines}, lambda l: {line}), ' '), '\s+', ' ', 'g')), '\s+([.,;:])', '\1', 'g')"
    return f"(SELECT CASE WHEN length(o) <= {most} THEN o ELSE rtrim(substr(o, 1, {most - 1})) || '…' END FROM (SELECT {out} AS o))"


EXCERPT_SQL = rf"""SELECT doc_id, {excerpt_sql('text', 220)} AS excerpt, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]\s+|\n+'), lambda s: trim(s)), lambda s: length(s) > 0)) AS n_sentences, replace(format('{{:,}}', n_chars * 1000), ',', ' ') AS size FROM documents"""


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names with signs from elsewhere mixed in, made plain, and how many ideographs were taken out."""
    mixed = F.concat("n_name", F.lit("，好"), F.col("n_nationkey"), F.lit("！✅"), F.when(F.col("n_nationkey") % 2 == 0, "字字").otherwise(""))
    plain, removed = G.cleaned(mixed)
    return table(spark, sf_dir, "nation").select("n_nationkey", plain.alias("plain"), removed.cast("bigint").alias("removed"))


CLEANED_SQL = "SELECT n_nationkey, n_name || ',' || n_nationkey || '!' AS plain, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS removed FROM nation"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nested requirement blocks (orders with their lines); a block without lines gives one row without points."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("ops"))
    blocks = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = blocks.select("o_orderkey", "o_orderpriority", F.explode_outer("ops").alias("op"))
    return rows.select("o_orderkey", F.coalesce(F.concat(F.lit("line "), F.col("op.l_linenumber").cast("string")), "o_orderpriority").alias("text"), F.col("op.l_quantity").alias("points"))


OPERATIONS_SQL = "SELECT o_orderkey, coalesce('line ' || l_linenumber, o_orderpriority) AS text, l_quantity AS points FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"


def capped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each order's lines that are seen under caps of one, three and five lines, in percent of all, by segment."""
    caps = spark.createDataFrame([(1,), (3,), (5,)], "cap int")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    per = lines.join(F.broadcast(caps)).groupBy("o_orderstatus", "cap").agg(F.sum(F.when(F.col("l_linenumber") <= F.col("cap"), F.col("l_quantity")).otherwise(0)).alias("seen"), F.sum("l_quantity").alias("total"))
    return per.select("o_orderstatus", "cap", "seen", F.round(100 * F.col("seen") / F.col("total"), 4).alias("percent"))


CAPPED_SQL = "SELECT o_orderstatus, cap::INTEGER AS cap, sum(CASE WHEN l_linenumber <= cap THEN l_quantity ELSE 0 END) AS seen, round(100 * sum(CASE WHEN l_linenumber <= cap THEN l_quantity ELSE 0 END) / sum(l_quantity), 4) AS percent FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES (1), (3), (5)) c(cap) GROUP BY 1, 2"


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklist items that documents trigger: all of the first words and any of the second."""
    items = [("a", ["the", "with"], ["idiot", "moron"]), ("b", ["der"], ["und", "die"]), ("c", ["les"], ["pour"])]
    text = F.lower("text")
    fits = lambda need, some: F.forall(F.array(*map(F.lit, need)), lambda w: F.contains(text, w)) & F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(text, w))
    hits = F.array_compact(F.array(*[F.when(fits(need, some), name) for name, need, some in items]))
    return _docs(spark, sf_dir).select("lang", F.explode(hits).alias("item")).groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))


CHECKLIST_SQL = """WITH t AS (SELECT lang, lower(text) AS t FROM documents), h AS (SELECT lang, unnest(list_filter([CASE WHEN contains(t, 'the') AND contains(t, 'with') AND (contains(t, 'idiot') OR contains(t, 'moron')) THEN 'a' END, CASE WHEN contains(t, 'der') AND (contains(t, 'und') OR contains(t, 'die')) THEN 'b' END, CASE WHEN contains(t, 'les') AND contains(t, 'pour') THEN 'c' END], lambda x: x IS NOT NULL)) AS item FROM t)
SELECT lang, item, count(*) AS n FROM h GROUP BY 1, 2"""


def composite_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index texts of parts from those fields that they have: a full one and one that only identifies the part."""
    price = F.when(F.col("p_retailprice") > 920, F.concat(F.lit("price "), F.format_number("p_retailprice", 1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", "p_name", F.nullif(F.col("p_type"), F.lit("PROMO")), price, "p_brand").alias("full_text"), F.concat_ws("\n", "p_name", "p_brand").alias("identity_text"))


COMPOSITE_SQL = "SELECT p_partkey, concat_ws(chr(10), p_name, nullif(p_type, 'PROMO'), CASE WHEN p_retailprice > 920 THEN 'price ' || format('{:,.1f}', p_retailprice) END, p_brand) AS full_text, concat_ws(chr(10), p_name, p_brand) AS identity_text FROM part"


def novel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of answers that no turn before them in the conversation has (without a few stop words)."""
    stop = ["the", "and", "of", "der", "die", "les", "de", "la"]
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).where(~F.col("word").isin(stop))
    first = words.groupBy("conv_id", "word").agg(F.min(F.struct("turn", "role")).alias("f"))
    return first.where("f.role = 'assistant'").groupBy("conv_id", F.col("f.turn").alias("turn")).agg(F.count(F.lit(1)).alias("n_novel"))


NOVEL_SQL = f"""WITH w AS (SELECT DISTINCT conv_id, turn, role, unnest({TOK.format('text')}) AS word FROM conversations), f AS (SELECT conv_id, word, min(turn) AS turn, arg_min(role, turn) AS role FROM w WHERE word NOT IN ('the', 'and', 'of', 'der', 'die', 'les', 'de', 'la') GROUP BY 1, 2)
SELECT conv_id, turn, count(*) AS n_novel FROM f WHERE role = 'assistant' GROUP BY 1, 2"""

QUERIES = {
    "pii_flags": (pii_flags, PII_SQL),
    "check_digits": (check_digits, CHECK_SQL),
    "ngram_coverage": (ngram_coverage, GRAMS_SQL),
    "unverified_numbers": (unverified_numbers, UNVERIFIED_SQL),
    "foreign_numbers": (foreign_numbers, FOREIGN_SQL),
    "routing": (routing, ROUTING_SQL),
    "excerpts": (excerpts, EXCERPT_SQL),
    "cleaned_texts": (cleaned_texts, CLEANED_SQL),
    "operations": (operations, OPERATIONS_SQL),
    "capped_points": (capped_points, CAPPED_SQL),
    "checklist": (checklist, CHECKLIST_SQL),
    "composite_texts": (composite_texts, COMPOSITE_SQL),
    "novel_words": (novel_words, NOVEL_SQL),
}
