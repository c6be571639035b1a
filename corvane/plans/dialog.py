"""Conversation queries: turns as of other turns, rollups, search and citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import excerpt, normalized
from corvane.operators import dialog as D
from corvane.plans.guards import excerpt_sql
from corvane.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def asof_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with the question before it."""
    return D.asof_question(_turns(spark, sf_dir))


ASOF_SQL = """SELECT conv_id, turn, question_turn, question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS question_turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS question
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'"""


def asof_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the first answer after it."""
    return D.asof_answer(_turns(spark, sf_dir))


ANSWER_SQL = "SELECT q.conv_id, q.turn, min(a.turn) AS answer_turn FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn > q.turn WHERE q.role = 'user' GROUP BY q.conv_id, q.turn"


def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without an answer."""
    return D.unanswered(_turns(spark, sf_dir))


UNANSWERED_SQL = "SELECT conv_id, turn, next_role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user' AND next_role IS DISTINCT FROM 'assistant'"


def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of every conversation."""
    return D.last_n(_turns(spark, sf_dir), 3).select("conv_id", "turn", "role", "back")


LAST_SQL = "SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3"


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an assistant turn: range, counts, characters, flags and the title (first user text)."""
    is_user = F.col("role") == "user"
    per = _turns(spark, sf_dir).groupBy("conv_id").agg(
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.length("text")).alias("n_chars"),
        F.max(F.when(F.length("text") < 200, 1).otherwise(0)).cast("bigint").alias("has_short"),
        F.count(F.when(F.col("role") == "system", 1)).alias("n_system"),
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("title"),
        F.count_if(F.col("role") == "assistant").alias("n_answers"),
    )
    per = per.where("n_answers > 0 AND has_short = 1")
    return per.join(F.broadcast(per.agg(F.count(F.lit(1)).alias("total"))))  # one row


ROLLUP_SQL = """SELECT *, count(*) OVER () AS total FROM (SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, max(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END)::BIGINT AS has_short,
 count(CASE WHEN role = 'system' THEN 1 END) AS n_system, arg_min(text, turn) FILTER (WHERE role = 'user') AS title, count(*) FILTER (WHERE role = 'assistant') AS n_answers FROM conversations GROUP BY conv_id) WHERE n_answers > 0 AND has_short = 1"""


def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which each word occurs somewhere, in whatever turn."""
    wanted = ["the", "that", "with"]
    hit = [F.max(F.col("t").contains(w).cast("int")) for w in wanted]
    per = _turns(spark, sf_dir).withColumn("t", normalized(F.col("text"))).groupBy("conv_id").agg(*[h.alias(f"w{i}") for i, h in enumerate(hit)], F.count(F.lit(1)).alias("n_turns"))
    return per.where(" AND ".join(f"w{i} = 1" for i in range(len(wanted)))).select("conv_id", "n_turns")


SEARCH_SQL = """SELECT conv_id, count(*) AS n_turns FROM (SELECT conv_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '\\[\\d+\\]|<\\d+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations)
 GROUP BY conv_id HAVING bool_or(contains(t, 'the')) AND bool_or(contains(t, 'that')) AND bool_or(contains(t, 'with'))"""


def dialog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten conversations, longest first, and how many there are."""
    per = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    total = per.agg(F.count(F.lit(1)).alias("total"))
    return per.orderBy(F.desc("n_chars"), "conv_id").offset(10).limit(10).join(F.broadcast(total))


PAGE_SQL = "SELECT *, (SELECT count(DISTINCT conv_id) FROM conversations) AS total FROM (SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id ORDER BY n_chars DESC, conv_id LIMIT 10 OFFSET 10)"


def open_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn whether a question stands open after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    state = F.last(F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False), ignorenulls=True).over(w)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(state, F.lit(False)).alias("is_open"))


OPEN_SQL = "SELECT conv_id, turn, coalesce(last_value(CASE role WHEN 'user' THEN true WHEN 'assistant' THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_open FROM conversations"


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under headings of recency, with a title cut to fit; their day is made of their number."""
    today = F.lit("2024-01-31").cast("date")
    per = _turns(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.max("turn").alias("last_turn"))
    day = F.date_sub(today, (F.col("conv_id") % 12 - 1).cast("int"))  # one day lies ahead
    return per.select("conv_id", D.recency(day, today).alias("heading"), excerpt(F.col("text"), 60).alias("title"), "last_turn")


HISTORY_SQL = r"""WITH per AS (SELECT conv_id, arg_min(text, turn) AS text, max(turn) AS last_turn, DATE '2024-01-31' - (conv_id % 12 - 1)::INTEGER AS day FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN day >= DATE '2024-01-31' THEN 'today' WHEN day = DATE '2024-01-30' THEN 'yesterday' WHEN date_trunc('week', day) = date_trunc('week', DATE '2024-01-31') THEN 'week' ELSE 'earlier' END AS heading,
 """ + excerpt_sql('text', 60) + " AS title, last_turn FROM per"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that bracketed numbers of an answer name; a bracket with any unknown number is dropped as a whole.

    The answers are made of the turns (turn and conversation give the numbers), the sources are three titles.
    """
    text = F.concat(F.lit("see ["), F.col("turn") % 4 + 1, F.lit(", "), F.col("conv_id") % 4 + 1, F.lit("] and ["), F.col("conv_id") % 3 + 1, F.lit("]"))
    sources = F.array(*map(F.lit, ("first", "second", "third")))
    groups = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), 1), lambda g: F.transform(F.split(g, r",\s*"), lambda n: n.cast("int")))
    good = F.filter(groups, lambda g: F.forall(g, lambda n: (n >= 1) & (n <= F.size(sources))))
    cited = F.array_distinct(F.flatten(good))
    rows = _turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.explode(cited).alias("number"), sources.alias("sources"))
    return rows.select("conv_id", "turn", "number", F.try_element_at("sources", F.col("number")).alias("title"))


CITE_SQL = r"""WITH a AS (SELECT conv_id, turn, 'see [' || (turn % 4 + 1) || ', ' || (conv_id % 4 + 1) || '] and [' || (conv_id % 3 + 1) || ']' AS t FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '\[(\d+(?:,\s*\d+)*)\]', 1)) AS g FROM a),
n AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(g, ',\s*'), lambda x: x::INTEGER) AS n FROM g)
SELECT DISTINCT conv_id, turn, number, ['first', 'second', 'third'][number] AS title FROM (SELECT conv_id, turn, unnest(n) AS number FROM n WHERE list_max(n) <= 3 AND list_min(n) >= 1)"""


def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns whose text (in normal form) an earlier turn of the conversation has already, and whether that one got an
    answer before."""
    w = Window.partitionBy("conv_id", "t").orderBy("turn")
    so_far = F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _turns(spark, sf_dir).withColumn("answers", so_far).where("role = 'user'").withColumn("t", normalized(F.col("text")))
    rows = rows.withColumn("before", F.lag("turn").over(w)).withColumn("answered", F.col("answers") > F.lag("answers").over(w))
    return rows.where("before IS NOT NULL").select("conv_id", "turn", "before", "answered")


REPEAT_SQL = r"""WITH a AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS answers FROM conversations),
t AS (SELECT conv_id, turn, answers, trim(regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '\[\d+\]|<\d+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a WHERE role = 'user')
SELECT conv_id, turn, before, answered FROM (SELECT conv_id, turn, lag(turn) OVER w AS before, answers > lag(answers) OVER w AS answered FROM t WINDOW w AS (PARTITION BY conv_id, t ORDER BY turn)) WHERE before IS NOT NULL"""


def dialog_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one Markdown text, in the order of its turns."""
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text"))
    per = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return per.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("markdown"))


MARKDOWN_SQL = "SELECT conv_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"

QUERIES = {
    "asof_question": (asof_question, ASOF_SQL),
    "asof_answer": (asof_answer, ANSWER_SQL),
    "unanswered": (unanswered, UNANSWERED_SQL),
    "last_n_turns": (last_n_turns, LAST_SQL),
    "session_rollup": (session_rollup, ROLLUP_SQL),
    "session_search": (session_search, SEARCH_SQL),
    "dialog_page": (dialog_page, PAGE_SQL),
    "open_question": (open_question, OPEN_SQL),
    "history_view": (history_view, HISTORY_SQL),
    "citations": (citations, CITE_SQL),
    "repeated_questions": (repeated_questions, REPEAT_SQL),
    "dialog_markdown": (dialog_markdown, MARKDOWN_SQL),
}
