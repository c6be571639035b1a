"""Queries of the streaming operators over the table events, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.admission import Cap, admitted
from corvane.sources.tables import table
from corvane.streaming import limits as L


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limiter of three a user and day admits, and when to try again."""
    return L.limited_batch(table(spark, sf_dir, "events"), "user_id", 3, 86_400.0)


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, true AS admitted, 0.0::DOUBLE AS retry_after, [tm] AS kept FROM e WHERE n = 1
 UNION ALL SELECT user_id, n, event_id, len(k) < 3, CASE WHEN len(k) < 3 THEN 0.0::DOUBLE ELSE round(k[1] + 86400.0::DOUBLE - tm, 6) END, CASE WHEN len(k) < 3 THEN list_append(k, tm) ELSE k END
 FROM (SELECT e.*, list_filter(r.kept, lambda t: t > e.tm - 86400.0::DOUBLE) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, admitted, retry_after FROM r"""


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by windows of six hours and kind."""
    return L.windowed_counts(table(spark, sf_dir, "events"), "1 day", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


WINDOW_SQL = "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by twelve hours without an event."""
    out = L.sessions(table(spark, sf_dir, "events"), "user_id", "12 hours", "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


SESSION_SQL = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS stop, count(*) AS n FROM s GROUP BY user_id, k"""


def reserved_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under three caps of a day at once (three for a user, two hundred for all, two for a user's kind of event), in the order
    of time; an error gives its place back after ten minutes."""
    refund = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", refund.alias("refund_ts"))
    caps = [Cap("personal", "concat_ws(' ', user_id, to_date(ts))", 3), Cap("daily", "to_date(ts)", 200), Cap("kind", "concat_ws(' ', user_id, event_type, to_date(ts))", 2, refunds=False)]
    return admitted(rows, caps)


RESERVED_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id AS u, event_type AS k, epoch_us(ts) AS tm, CASE WHEN event_type = 'error' THEN epoch_us(ts) + 600000000 END AS f, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT day, n, event_id, 'admitted' AS verdict, [{'u': u, 'k': k, 'f': f}] AS taken FROM e WHERE n = 1
 UNION ALL SELECT day, n, event_id, v, CASE WHEN v = 'admitted' THEN list_append(taken, {'u': u, 'k': k, 'f': f}) ELSE taken END FROM
 (SELECT e.*, taken, CASE WHEN len(list_filter(taken, lambda t: t.u = e.u AND (t.f IS NULL OR t.f > e.tm))) >= 3 THEN 'personal' WHEN len(list_filter(taken, lambda t: t.f IS NULL OR t.f > e.tm)) >= 200 THEN 'daily'
   WHEN len(list_filter(taken, lambda t: t.u = e.u AND t.k = e.k)) >= 2 THEN 'kind' ELSE 'admitted' END AS v FROM r JOIN e ON e.day = r.day AND e.n = r.n + 1))
SELECT event_id, verdict FROM r"""


QUERIES = {
    "reserved_caps": (reserved_caps, RESERVED_SQL),
    "rate_limit": (rate_limit, RATE_SQL),
    "windowed_counts": (windowed_counts, WINDOW_SQL),
    "user_sessions": (user_sessions, SESSION_SQL),
}
