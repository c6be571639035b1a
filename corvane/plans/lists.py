"""Lists, routes and composite views: capped and reordered lists, windows with late additions, filters, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import route as Q
from corvane.functions import text as T
from corvane.operators import codes as C
from corvane.operators import dialog as D
from corvane.operators import lexical
from corvane.operators import retrieval as R
from corvane.plans.codes import CODES, _codes
from corvane.plans.retrieval import BM25_CTE, KNN_CTE, TOK, _knn
from corvane.sources import store
from corvane.sources.tables import table


def capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each order, returned lines (the list's headings) free, and how many there are and are left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("heading"))
    return R.capped(lines, ["l_orderkey"], ["l_linenumber"], 3, "heading")


CAPPED_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS heading FROM lineitem),
n AS (SELECT *, sum((NOT heading)::INTEGER) OVER (PARTITION BY l_orderkey)::BIGINT AS total, sum((NOT heading)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nr FROM l)
SELECT l_orderkey, l_linenumber, heading, total, greatest(total - 3, 0) AS rest FROM n WHERE nr <= 3 OR heading"""


def reordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation by role, then by the words they share with its first user turn, then as they were."""
    turns = table(spark, sf_dir, "conversations").withColumn("words", F.array_distinct(T.tokens(F.col("text"))))
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("words", "turn").alias("asked"))
    return R.reordered(turns.join(first, "conv_id"), ["conv_id"], "role", "words", "asked", "turn").select("conv_id", "turn", "overlap", "place")


REORDERED_SQL = f"""WITH t AS (SELECT conv_id, turn, role, list_distinct({TOK.format('text')}) AS w FROM conversations), f AS (SELECT conv_id, arg_min(w, turn) AS asked FROM t WHERE role = 'user' GROUP BY 1),
o AS (SELECT conv_id, turn, role, len(list_intersect(w, asked)) AS overlap FROM t JOIN f USING (conv_id))
SELECT conv_id, turn, overlap, row_number() OVER (PARTITION BY conv_id ORDER BY role, overlap DESC, turn) AS place FROM o"""


def extended_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight neighbours, to which the neighbours of even id among the ranks 5 to 12 are added."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    near = _knn(spark, sf_dir, 12).join(labels, "item_id").join(labels.toDF("query_id", "own"), "query_id")
    window = near.where("rank <= 8").select("query_id", "item_id", "rank", (F.col("label") == F.col("own")).alias("matched"))
    return R.inserted(window, near.where("rank > 4 AND item_id % 2 = 0").select("query_id", "item_id", "rank"), 8)


EXTENDED_SQL = f"""WITH {KNN_CTE}, w AS (SELECT query_id, item_id, rank, label = query_label OR (rank > 4 AND item_id % 2 = 0) AS matched, false AS added FROM near WHERE rank <= 8
 UNION ALL SELECT query_id, item_id, rank, true, true FROM near WHERE rank BETWEEN 9 AND 12 AND item_id % 2 = 0),
n AS (SELECT *, NOT matched AND NOT added AS may, greatest(count(*) OVER (PARTITION BY query_id) - 8, 0) AS over_ FROM w),
o AS (SELECT *, sum(may::INTEGER) OVER (PARTITION BY query_id ORDER BY added DESC, rank DESC) AS back FROM n)
SELECT query_id, item_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY added, rank) AS place FROM o WHERE NOT (may AND back <= over_)"""


def match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with any of a few codes among their own and those above."""
    rows = _codes(spark, sf_dir).withColumn("above", C.prefixes(F.col("code")))
    return R.match_any(rows, "above", ["11.05", "13", "23.50.2"]).select("p_partkey", "code")


MATCH_SQL = f"WITH {CODES} SELECT p_partkey, code FROM codes WHERE code = '11.05' OR starts_with(code, '11.05.') OR code = '13' OR starts_with(code, '13.') OR code = '23.50.2' OR starts_with(code, '23.50.2.')"


def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by words (all, in any field, e and yo alike), role, status and plan; '-' stands for no plan."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    plan = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    hay = T.normalized(F.concat_ws(" ", "c_name", "n_name", "c_mktsegment"))
    filters = [("1", "", "", "-"), ("customer 7", "", "active", ""), ("", "", "blocked", "MACHINERY")]
    out = None
    for i, (words, role, status, wanted) in enumerate(filters):
        keep = F.lit(True)
        for w in words.lower().replace("ё", "е").split():
            keep = keep & F.contains(hay, F.lit(w))
        keep = keep & (plan.isNull() if wanted == "-" else plan == wanted if wanted else F.lit(True))
        blocked = F.col("c_acctbal") < 0
        keep = keep & {"active": ~blocked, "blocked": blocked, "": F.lit(True)}[status]
        keep = keep & (F.col("n_name") == role if role else F.lit(True))
        one = rows.where(keep).select(F.lit(i).alias("filter"), "c_custkey")
        out = one if out is None else out.unionAll(one)
    return out


USERS_SQL = """WITH r AS (SELECT *, lower(concat_ws(' ', c_name, n_name, c_mktsegment)) AS hay FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 0 AS filter, c_custkey FROM r WHERE contains(hay, '1') AND c_mktsegment = 'BUILDING' UNION ALL SELECT 1, c_custkey FROM r WHERE contains(hay, 'customer') AND contains(hay, '7') AND c_acctbal >= 0
UNION ALL SELECT 2, c_custkey FROM r WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'"""

ROUTES = [
    Q.Rule("footnote", some=[r"<\d+>"], never=[r"\d{2}\.\d{2}"]),
    Q.Rule("procedure", some=[" with ", " avec "], every=[" the | les "], never=[" von "]),
    Q.Rule("follow-up", some=["^(?:and|et|und)", " it "], most=600),
    Q.Rule("product", some=[r"\d{2}\.\d{2}", " der | die "]),
]


def routed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn goes by a table of rules, first fit."""
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.regexp_replace(F.lower("text"), r"\s+", " "))
    return rows.select("conv_id", "turn", Q.routed(F.col("t"), ROUTES, "other").alias("route"))


ROUTED_SQL = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '<\d+>') AND NOT regexp_matches(t, '\d{2}\.\d{2}') THEN 'footnote' WHEN regexp_matches(t, ' with | avec ') AND regexp_matches(t, ' the | les ') AND NOT contains(t, ' von ') THEN 'procedure'
 WHEN (regexp_matches(t, '^(?:and|et|und)') OR contains(t, ' it ')) AND length(trim(t)) <= 600 THEN 'follow-up' WHEN regexp_matches(t, '\d{2}\.\d{2}') OR regexp_matches(t, ' der | die ') THEN 'product' ELSE 'other' END AS route FROM t"""


def answer_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of every answer: by the corpus it used, the kinds of its sources, or its question; made of its numbers."""
    turns = D.asof_question(table(spark, sf_dir, "conversations"))
    corpus = F.when(F.col("turn") % 3 == 0, "appendix_a|x").when(F.col("turn") % 3 == 1, "rules|y")
    kinds = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("rule"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("rule"), F.lit("item")))
    rules = [Q.Rule("rules", some=[" the "]), Q.Rule("other")]
    return turns.select("conv_id", "turn", Q.branch(corpus, kinds, F.regexp_replace("question", r"\s+", " "), rules, {"appendix": "goods"}, "goods").alias("branch"))


BRANCH_SQL = r"""WITH a AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'goods' WHEN turn % 3 = 1 THEN 'rules' WHEN conv_id % 3 = 0 THEN 'rules' WHEN conv_id % 3 = 1 THEN 'goods' WHEN contains(regexp_replace(coalesce(q, ''), '\s+', ' ', 'g'), ' the ') THEN 'rules' ELSE 'other' END AS branch FROM a WHERE role = 'assistant'"""


def anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last code, less dates, that a user has named up to each turn; the codes are made of the turns' numbers."""
    said = F.when(F.col("role") == "user", F.concat(F.lit("code 28."), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"), F.when(F.col("turn") % 4 == 0, ".10").otherwise(""), F.lit(" from 27.12.2023")))
    codes = F.filter(F.regexp_extract_all(said, F.lit(r"(\d{2}(?:\.\d+)+)"), 1), lambda c: ~c.rlike(r"^\d{2}\.\d{2}\.\d{4}$"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.try_element_at(codes, F.lit(-1)), ignorenulls=True).over(w).alias("anchor"))


ANCHOR_CODES_SQL = """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN '28.' || lpad((conv_id % 100)::VARCHAR, 2, '0') || CASE WHEN turn % 4 = 0 THEN '.10' ELSE '' END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM conversations"""


def citation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two lists each answer's bracketed numbers cite; the numbers are made of its turn and conversation."""
    claim = F.concat(F.lit("as ["), F.col("turn") % 6 + 1, F.lit("] says"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" and [ "), F.col("conv_id") % 7 + 1, F.lit(" ]"))).otherwise(""))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", Q.cited_scope(claim, F.lit(3)).alias("scope"))


SCOPE_SQL = """WITH n AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN [turn % 6 + 1, conv_id % 7 + 1] ELSE [turn % 6 + 1] END AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN list_min(n) > 3 THEN 'rules' WHEN list_max(n) > 3 THEN 'both' ELSE 'hits' END AS scope FROM n"""


def claimed_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in days that answers claim without a source; answers, contexts and questions are made of events' numbers."""
    n = F.col("event_id")
    answer = F.concat(F.lit("in "), n % 9 + 1, F.lit(" working days, or "), n % 5 + 1, F.lit(" calendar days, in "), n % 4, F.lit(" copies"))
    rows = table(spark, sf_dir, "events").select("event_id", Q.unverified_deadlines(answer, F.concat(F.lit("term: "), n % 7 + 1), F.concat(F.lit("in "), n % 3 + 1, F.lit(" days?"))).alias("d"))
    return rows.select("event_id", F.array_join("d", "|").alias("deadlines"))


DEADLINES_SQL = """WITH d AS (SELECT event_id, [event_id % 9 + 1, event_id % 5 + 1] AS a, [event_id % 7 + 1, event_id % 3 + 1] AS k FROM events)
SELECT event_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i AND NOT list_contains(k, x)), '|') AS deadlines FROM d"""


def latest_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest amendment that each customer's text names; the texts are made of the dates and numbers of orders."""
    mark = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" N "), F.col("o_orderkey") % 50)
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("as of 01.01.2030, amended "), F.array_join(F.collect_list(mark), ", ")).alias("t"))
    return per.select("o_custkey", Q.latest_amendment(F.col("t")).alias("a")).select("o_custkey", "a.y", "a.m", "a.d", "a.number")


AMENDED_SQL = """WITH m AS (SELECT o_custkey, max({'y': year(o_orderdate), 'm': month(o_orderdate), 'd': day(o_orderdate), 'number': o_orderkey % 50}) AS a FROM orders GROUP BY 1)
SELECT o_custkey, a.y::INTEGER AS y, a.m::INTEGER AS m, a.d::INTEGER AS d, a.number::INTEGER AS number FROM m"""


def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's name is the one that its code has in the directory (the least name of the code's key)."""
    rows = _codes(spark, sf_dir).withColumn("k", C.key(F.col("code")))
    known = rows.groupBy("k").agg(F.min(T.normalized(F.col("p_name"))).alias("official"))
    return rows.join(known, "k", "left").select("p_partkey", F.coalesce(T.normalized(F.col("p_name")) == F.col("official"), F.lit(False)).alias("is_group"))


GROUP_SQL = f"WITH {CODES} SELECT p_partkey, lower(p_name) = min(lower(p_name)) OVER (PARTITION BY replace(code, '.', '')) AS is_group FROM codes"


def anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short labels of source anchors, made of nations' keys; every fifth has another form."""
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "IX", "XL"))), (F.col("n_nationkey") % 6 + 1).cast("int"))
    anchor = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("Part "), "n_nationkey")).otherwise(F.concat(F.lit("Section "), roman, F.lit(",  item "), F.col("n_nationkey") + 10))
    return table(spark, sf_dir, "nation").select("n_nationkey", Q.anchor_label(anchor).alias("label"))


LABELS_SQL = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN 'Sec. ' || ['I', 'II', 'III', 'IV', 'IX', 'XL'][n_nationkey % 6 + 1] || ', item ' || (n_nationkey + 10) END AS label FROM nation"


def bent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a slip of the pen, and abbreviated."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", Q.with_typo(F.col("p_name"), F.col("p_partkey")).alias("typo"), Q.abbreviated(F.col("p_name"), {"small": "sm.", "eco": "ec."}).alias("short"))


_NEAR = "'abcdefghijklmnopqrstuvwxyz', 'svnfrdgjkohklbmipqwerytzxa'"
BENT_SQL = rf"""WITH s AS (SELECT p_partkey, p_name AS t, list_filter(range(1, length(p_name) + 1), lambda i: regexp_matches(p_name[i], '\p{{L}}')) AS spots FROM part),
i AS (SELECT *, spots[p_partkey % len(spots) + 1] AS i, (p_partkey // 7) % 4 AS kind FROM s),
a AS (SELECT *, regexp_replace(regexp_replace(t, '(?i)\bsmall\w*', 'sm.', 'g'), '(?i)\beco\w*', 'ec.', 'g') AS ab, regexp_extract_all(t, '\p{{L}}{{6,}}') AS w FROM i),
l AS (SELECT *, list_sort(list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y)))))[1] AS lw FROM a)
SELECT p_partkey, CASE WHEN len(spots) < 3 THEN t WHEN kind = 0 THEN t[1:i - 1] || t[i + 1] || t[i] || substr(t, i + 2) WHEN kind = 1 THEN t[1:i - 1] || substr(t, i + 1) WHEN kind = 2 THEN t[1:i] || substr(t, i) ELSE t[1:i - 1] || translate(t[i], {_NEAR}) || substr(t, i + 1) END AS typo,
 CASE WHEN ab <> t THEN ab WHEN lw IS NOT NULL THEN substr(t, 1, instr(t, lw) - 1) || lw[1:4] || '.' || substr(t, instr(t, lw) + length(lw)) ELSE t END AS short FROM l"""


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of English documents (endings taken off) and in how many documents they occur."""
    stems = F.explode(F.array_distinct(Q.stemmed(T.tokens(F.col("text")), ["ing", "ed", "s", "ly", "tion"]))).alias("stem")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", stems).groupBy("stem").agg(F.count(F.lit(1)).alias("n_docs"))


STEM_SQL = f"SELECT stem, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(list_transform({TOK.format('text')}, lambda w: regexp_replace(w, '^(.{{3,}}?)(?:tion|ing|ed|ly|s)$', '\\1')))) AS stem FROM documents WHERE lang = 'en') GROUP BY 1"


def guest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forty questions of the trial (conversations of even number) with their answers, and how many came in all."""
    turns = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0")
    asked = turns.where("role = 'user'")
    replies = D.asof_answer(turns).where("answer_turn IS NOT NULL")
    text = turns.select("conv_id", F.col("turn").alias("answer_turn"), F.col("text").alias("answer"))
    page = asked.join(replies, ["conv_id", "turn"], "left").orderBy(F.desc("conv_id"), F.desc("turn")).limit(40)
    total = asked.agg(F.count(F.lit(1)).alias("total"))
    rows = page.join(text, ["conv_id", "answer_turn"], "left").join(F.broadcast(total))  # one row
    return rows.select("conv_id", "turn", F.sha1("text").alias("question"), F.sha1("answer").alias("answer"), "total", (F.col("total") > 100).alias("over_cap"))


GUEST_SQL = """WITH t AS (SELECT * FROM conversations WHERE conv_id % 2 = 0), a AS (SELECT *, first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM t),
u AS (SELECT *, count(*) OVER () AS total FROM a WHERE role = 'user')
SELECT conv_id, turn, sha1(text) AS question, sha1(answer) AS answer, total, total > 100 AS over_cap FROM u ORDER BY conv_id DESC, turn DESC LIMIT 40"""


def lead_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that wait for a decision (of a kind, or of a segment; new or in work), oldest first, each with its place."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey").where("(o_orderpriority = '1-URGENT' OR c_mktsegment = 'MACHINERY') AND o_orderstatus IN ('O', 'P')")
    # places are counted by day: no day has many
    day = F.to_date("o_orderdate")
    before = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    starts = before.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a day
    place = F.row_number().over(Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey"))
    return rows.withColumn("day", day).withColumn("in_day", place).join(starts, "day").select("o_orderkey", (F.col("start") + F.col("in_day")).alias("place"))


LEAD_SQL = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderpriority = '1-URGENT' OR c_mktsegment = 'MACHINERY') AND o_orderstatus IN ('O', 'P')"


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality scorecard as one table (section, metric, value): activity, acceptance with its interval, grades, times by
    nearest rank, days, the change against the days before."""
    rating = F.floor(F.col("value") % 6)
    rows = table(spark, sf_dir, "events").withColumn("rating", rating).withColumn("day", D.local_day(F.col("ts"))).withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    latest = D.latest_wins(rows.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"])
    one = rows.agg(
        F.count(F.lit(1)).cast("double").alias("activity.events"),
        F.countDistinct("user_id").cast("double").alias("activity.users"),
        F.countDistinct("day").cast("double").alias("activity.days"),
        F.count_if(F.col("late")).cast("double").alias("activity.late"),
        F.round(F.bround(100.0 * (F.count_if(F.col("late")) - F.count_if(~F.col("late"))) / F.count_if(~F.col("late")), 0), 1).alias("activity.trend"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("failures.errors"),
        F.round(F.avg("value"), 4).alias("value.mean"),
    )
    low, high = D.wilson(F.count_if(F.col("rating") >= 3), F.count(F.lit(1)))
    grades = [F.count_if(F.col("rating") == g).cast("double").alias(f"grades.{g}") for g in range(6)]
    two = latest.agg(F.count(F.lit(1)).cast("double").alias("acceptance.rated"), F.round(F.avg((F.col("rating") >= 3).cast("double")), 6).alias("acceptance.share"), F.round(low, 6).alias("acceptance.low"), F.round(high, 6).alias("acceptance.high"), *grades)
    long = None
    for wide in (one, two):
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in wide.columns])
        rows_of = wide.select(F.explode(cells).alias("x")).select(F.substring_index("x.name", ".", 1).alias("section"), F.substring_index("x.name", ".", -1).alias("metric"), "x.value")
        long = rows_of if long is None else long.unionAll(rows_of)
    return long


SCORECARD_SQL = """WITH r AS (SELECT *, floor(value % 6) AS rating, (ts + INTERVAL 3 HOURS)::DATE AS day, ts >= TIMESTAMP '2024-01-16' AS late FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM r WHERE event_type = 'purchase') WHERE rn = 1),
a AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE rating >= 3)::DOUBLE AS k FROM l), w AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM a)
SELECT 'activity' AS section, 'events' AS metric, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'activity', 'users', count(DISTINCT user_id) FROM r UNION ALL SELECT 'activity', 'days', count(DISTINCT day) FROM r UNION ALL SELECT 'activity', 'late', count(*) FILTER (WHERE late) FROM r
UNION ALL SELECT 'activity', 'trend', round_even(100.0::DOUBLE * (count(*) FILTER (WHERE late) - count(*) FILTER (WHERE NOT late)) / count(*) FILTER (WHERE NOT late), 0) FROM r UNION ALL SELECT 'failures', 'errors', count(*) FILTER (WHERE event_type = 'error') FROM r UNION ALL SELECT 'value', 'mean', round(avg(value), 4) FROM r
UNION ALL SELECT 'acceptance', 'rated', n FROM w UNION ALL SELECT 'acceptance', 'share', round(p, 6) FROM w UNION ALL SELECT 'acceptance', 'low', round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) FROM w UNION ALL SELECT 'acceptance', 'high', round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) FROM w
UNION ALL SELECT 'grades', g::VARCHAR, (SELECT count(*) FROM l WHERE rating = g) FROM range(0, 6) t(g)"""


def rules_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules search with quotas: the best forty documents of a passage, topped up with the subject's source (its best three)
    and the best long document; twelve places by quota, long documents first, then the subject's, then by rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 2000).alias("is_list"))
    # what can be among the best of all, of the subject's source or of the long ones is among the best of one of four kinds of documents
    kinds = docs.groupBy("doc_id").agg((F.max(F.when(F.col("source") == "src0", 2).otherwise(0)) + F.max(F.when(F.col("is_list"), 1).otherwise(0))).alias("g"))
    scored = lexical.of_table(table(spark, sf_dir, "documents"), scope="source").bm25(table(spark, sf_dir, "benchmark"), "item_id", best=40, groups=kinds)
    scored = scored.select(F.col("item_id").alias("query_id"), "doc_id", F.round("score", 6).alias("score"))
    scored = store.stored(scored, "scores").join(docs, "doc_id")  # read three times
    best = [F.desc("score"), F.asc("doc_id")]
    pool = R.top_k(scored, "query_id", best, 40).drop("rank")
    topped = pool.unionByName(R.top_k(scored.where("source = 'src0'"), "query_id", best, 3).drop("rank")).unionByName(R.top_k(scored.where("is_list"), "query_id", best, 1).drop("rank")).distinct()
    ranked = topped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    own = F.coalesce(F.col("source") == "src0", F.lit(False))
    quota = F.when(own, 3).otherwise(2)
    window = R.quota_window(ranked, "source", quota, 12, [~own, F.col("source")], [~F.col("is_list"), ~own])
    return window.select("query_id", "doc_id", "source", "is_list", "rank", "place")


RULES_SQL = f"""WITH {BM25_CTE}, s AS (SELECT item_id AS query_id, doc_id, round(score, 6) AS score, d.source, d.n_chars > 2000 AS is_list FROM bm JOIN documents d USING (doc_id)),
p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 40 UNION (SELECT * FROM s WHERE source = 'src0' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3) UNION (SELECT * FROM s WHERE is_list QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 1)),
r AS (SELECT *, coalesce(source = 'src0', false) AS own, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= CASE WHEN own THEN 3 ELSE 2 END AS chosen, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn FROM r),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chosen DESC, CASE WHEN chosen THEN turn END NULLS FIRST, CASE WHEN chosen THEN NOT own END NULLS FIRST, CASE WHEN chosen THEN source END NULLS FIRST, rank) <= 12)
SELECT query_id, doc_id, source, is_list, rank, row_number() OVER (PARTITION BY query_id ORDER BY NOT is_list, NOT own, rank) AS place FROM f"""


def code_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-boosted search in full: a pool by name, the queried code's branch, exact codes and (only if no code is the same or
    below) the nearest above; all scored on one scale of shared words, then ranked by tier."""
    rows = R.with_class(_codes(spark, sf_dir).withColumn("k", C.digits(F.col("code"))), T.tokens(F.concat_ws(" ", "p_name", "p_type"))).select("p_partkey", "k", "cls")
    queries = rows.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("k").alias("q"), F.col("cls").alias("qcls"))
    scores = store.stored(R.class_scores(queries, rows).drop("matched"), "scores")

    def best(q_group: Column, group: Column, k: int, fill: bool) -> DataFrame:
        """The best k parts of each query's group."""
        mine = queries.withColumn("grp", q_group)
        found = R.best_in_groups(mine, rows.select("p_partkey", "cls", group.alias("grp")), scores, "p_partkey", ["score"], k, fill)
        return mine.select("query_id", "qcls", "grp").join(found, ["qcls", "grp"]).select("query_id", "p_partkey")

    prefix = lambda c: F.substring(c, 1, 2)
    # of exact codes no more than the ten that can be returned
    wanted = best(F.lit(0), F.lit(0), 40, False).union(best(prefix("q"), prefix("k"), 12, True)).union(best(F.col("q"), F.col("k"), 10, True))
    keys = rows.select("k").distinct()
    has = keys.select(F.explode(C.key_prefixes(F.col("k"), 1)).alias("q")).distinct()
    up = queries.join(has, "q", "left_anti").select("query_id", F.explode(C.key_prefixes(F.col("q"), 1)).alias("k")).join(keys, "k")
    nearest = up.groupBy("query_id").agg(F.max_by("k", F.length("k")).alias("k"))
    wanted = wanted.union(nearest.join(rows, "k").select("query_id", "p_partkey")).distinct()
    hits = wanted.join(queries, "query_id").join(rows, "p_partkey").join(scores, ["qcls", "cls"], "left").fillna(0.0, ["score"])
    relation = F.when(F.startswith("k", F.col("q")) | F.startswith("q", F.col("k")), (F.length("k") - F.length("q")).cast("bigint"))
    ranked = R.top_k(R.code_tiers(hits.select("query_id", "p_partkey", "score", relation.alias("relation"))), "query_id", [F.asc("tier"), F.desc("score"), F.asc("p_partkey")], 10)
    return ranked.select("query_id", "p_partkey", F.col("tier").cast("bigint").alias("tier"), "score", "rank")


HYBRID_CODE_SQL = f"""WITH {CODES}, k AS (SELECT *, replace(code, '.', '') AS k FROM codes), w AS (SELECT p_partkey, unnest(list_distinct({TOK.format("concat_ws(' ', p_name, p_type)")})) AS term FROM codes),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM part) / count(*)::DOUBLE) AS idf FROM w GROUP BY 1), q AS (SELECT p_partkey AS query_id, k AS q FROM k WHERE p_partkey % 20 = 0),
s AS (SELECT a.p_partkey AS query_id, b.p_partkey, round(sum(idf), 6) AS score FROM w a JOIN idf USING (term) JOIN w b USING (term) WHERE a.p_partkey % 20 = 0 GROUP BY 1, 2),
c AS (SELECT query_id, p_partkey, length(k) - length(q) AS relation FROM q JOIN k ON starts_with(k, q) OR starts_with(q, k)),
br AS (SELECT query_id, k.p_partkey, coalesce(score, 0) AS score FROM q JOIN k ON left(k, 2) = left(q, 2) LEFT JOIN s USING (query_id, p_partkey)),
has AS (SELECT DISTINCT query_id FROM c WHERE relation >= 0), ab AS (SELECT *, max(relation) OVER (PARTITION BY query_id) AS top FROM c WHERE relation < 0 AND query_id NOT IN (SELECT query_id FROM has)),
wanted AS (SELECT query_id, p_partkey FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) <= 40 UNION (SELECT query_id, p_partkey FROM br QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) <= 12) UNION SELECT query_id, p_partkey FROM c WHERE relation = 0 UNION SELECT query_id, p_partkey FROM ab WHERE relation = top),
h AS (SELECT query_id, p_partkey, coalesce(score, 0) AS score, relation FROM wanted LEFT JOIN s USING (query_id, p_partkey) LEFT JOIN c USING (query_id, p_partkey)),
t AS (SELECT *, CASE WHEN relation = 0 THEN 0 WHEN relation > 0 THEN 1 WHEN relation < 0 AND NOT bool_or(coalesce(relation > 0, false)) OVER x AND relation = max(CASE WHEN relation < 0 THEN relation END) OVER x THEN 2 ELSE 3 END::BIGINT AS tier FROM h WINDOW x AS (PARTITION BY query_id))
SELECT query_id, p_partkey, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, p_partkey) AS rank FROM t QUALIFY rank <= 10"""

QUERIES = {
    "capped_list": (capped_list, CAPPED_SQL),
    "reordered_turns": (reordered_turns, REORDERED_SQL),
    "extended_window": (extended_window, EXTENDED_SQL),
    "match_any": (match_any, MATCH_SQL),
    "user_filter": (user_filter, USERS_SQL),
    "routed_turns": (routed_turns, ROUTED_SQL),
    "answer_branches": (answer_branches, BRANCH_SQL),
    "anchor_codes": (anchor_codes, ANCHOR_CODES_SQL),
    "citation_scopes": (citation_scopes, SCOPE_SQL),
    "claimed_deadlines": (claimed_deadlines, DEADLINES_SQL),
    "latest_amendments": (latest_amendments, AMENDED_SQL),
    "group_names": (group_names, GROUP_SQL),
    "anchor_labels": (anchor_labels, LABELS_SQL),
    "bent_names": (bent_names, BENT_SQL),
    "stem_counts": (stem_counts, STEM_SQL),
    "guest_view": (guest_view, GUEST_SQL),
    "lead_queue": (lead_queue, LEAD_SQL),
    "scorecard": (scorecard, SCORECARD_SQL),
    "rules_window": (rules_window, RULES_SQL),
    "code_hybrid": (code_hybrid, HYBRID_CODE_SQL),
}
