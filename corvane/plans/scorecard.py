"""Scorecard queries over events, labels, customers and orders, with their SQL.

Events stand for answers and ratings (value 0-5 made of value modulo 6), labels for verdicts on documents, orders for
usage of customers, who belong to nations and regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import dialog as D
from corvane.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last click and number of clicks of every user within optional bounds."""
    rows = D.optional_filters(_events(spark, sf_dir), since="2024-01-05", until="2024-01-25").where("event_type = 'click'")
    return rows.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


ACTIVITY_SQL = "SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY user_id"


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts for each local day of an inclusive window."""
    rows = _events(spark, sf_dir).where(D.in_local_days(F.col("ts"), "2024-01-03", "2024-01-20"))
    return rows.groupBy(D.local_day(F.col("ts")).alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"), F.countDistinct("user_id").alias("users"))


FLAGS_SQL = "SELECT (ts + INTERVAL 3 HOURS)::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 20) AS large, count(DISTINCT user_id) AS users FROM events WHERE (ts + INTERVAL 3 HOURS)::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1"


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted share of labelled documents by source in whole percent (half to even); null where none is labelled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    per = rows.groupBy("source").agg(F.count("quality").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).cast("bigint").alias("good"))
    return per.select("source", "n", "good", D.accept_percent(F.col("good"), F.col("n")).alias("percent"))


ACCEPT_SQL = "SELECT source, count(quality) AS n, coalesce(sum(quality), 0)::BIGINT AS good, CASE WHEN count(quality) > 0 THEN round_even(100.0::DOUBLE * sum(quality) / count(quality), 0)::BIGINT END AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events for each rating from 7 to 0, zero bins included."""
    rated = _events(spark, sf_dir).groupBy(F.floor(F.col("value") % 6).cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(8).select(F.col("id").cast("int").alias("rating"))
    return bins.join(rated, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


HISTOGRAM_SQL = "SELECT b.rating::INTEGER AS rating, count(e.event_id) AS n FROM range(8) b(rating) LEFT JOIN events e ON floor(e.value % 6) = b.rating GROUP BY b.rating"


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 14 days with events: clicks and summed value of views."""
    per = _events(spark, sf_dir).groupBy(D.local_day(F.col("ts")).alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("requests"), F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), 2).alias("spent"))
    return per.orderBy(F.desc("day")).limit(14)


DAILY_SQL = "SELECT (ts + INTERVAL 3 HOURS)::DATE AS day, count(*) FILTER (WHERE event_type = 'click') AS requests, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS spent FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14"


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a week beside the week before, for every user and kind."""
    day = D.local_day(F.col("ts"))
    now = (day >= "2024-01-15") & (day <= "2024-01-21")
    before = (day >= "2024-01-08") & (day <= "2024-01-14")
    per = _events(spark, sf_dir).where(now | before).groupBy("user_id", "event_type").agg(F.count_if(now).alias("current"), F.count_if(before).alias("previous"))
    return per.select("user_id", "event_type", "current", "previous", D.trend(F.col("current"), F.col("previous")).alias("trend"))


TREND_SQL = """WITH p AS (SELECT user_id, event_type, count(*) FILTER (WHERE d >= DATE '2024-01-15') AS current, count(*) FILTER (WHERE d < DATE '2024-01-15') AS previous FROM (SELECT *, (ts + INTERVAL 3 HOURS)::DATE AS d FROM events) WHERE d BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY ALL),
c AS (SELECT *, CASE WHEN previous > 0 THEN round_even(100.0::DOUBLE * (current - previous) / previous, 0)::BIGINT END AS change FROM p)
SELECT user_id, event_type, current, previous, CASE WHEN previous = 0 AND current = 0 THEN NULL WHEN previous = 0 THEN 'new' ELSE CASE WHEN change > 0 THEN '+' ELSE '' END || change || '%' END AS trend FROM c"""


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, and how many it stands for."""
    return D.latest_wins(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "n_rows")


LATEST_SQL = "SELECT user_id, event_type, event_id, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n_rows FROM events) WHERE rn = 1"


def rating_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by status, of which the first that fits counts: orphan, superseded, withdrawn, counted.

    Purchases rate the customer with the user's id times ten; a rating of zero is a withdrawal.
    """
    rated = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("user_id") * 10 + F.col("event_id") % 3).alias("c_custkey"), F.floor(F.col("value") % 6).alias("rating"))
    known = table(spark, sf_dir, "customer").select("c_custkey", F.lit(True).alias("known"))
    last = F.row_number().over(Window.partitionBy("user_id", "c_custkey").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = rated.withColumn("last", last).join(known, "c_custkey", "left")
    status = F.when(F.col("known").isNull(), "orphan").when(F.col("last") > 1, "superseded").when(F.col("rating") == 0, "withdrawn").otherwise("counted")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


STATUS_SQL = """WITH r AS (SELECT *, user_id * 10 + event_id % 3 AS k, floor(value % 6) AS rating FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS last FROM r)
SELECT CASE WHEN c_custkey IS NULL THEN 'orphan' WHEN last > 1 THEN 'superseded' WHEN rating = 0 THEN 'withdrawn' ELSE 'counted' END AS status, count(*) AS n, round(avg(rating), 6) AS mean FROM s LEFT JOIN customer ON c_custkey = k GROUP BY 1"""


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in total, by kind, by day, by user group, and two cross tables of them."""
    rows = _events(spark, sf_dir).select("event_type", D.local_day(F.col("ts")).alias("day"), (F.col("user_id") % 5).alias("user_group"), "value")
    sets = [[], ["event_type"], ["day"], ["user_group"], ["event_type", "day"], ["user_group", "day"]]
    cols = [F.col(c) for c in ("event_type", "day", "user_group")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


SETS_SQL = """SELECT event_type, day, user_group, grouping(event_type, day, user_group)::BIGINT AS level, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, (ts + INTERVAL 3 HOURS)::DATE AS day, user_id % 5 AS user_group, value FROM events)
 GROUP BY GROUPING SETS ((), (event_type), (day), (user_group), (event_type, day), (user_group, day))"""


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted share by language with its 95 % interval and the sample that half a tenth of width would need."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("good"))
    low, high = D.wilson(F.col("good"), F.col("n"))
    return per.select("lang", "n", "good", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), D.sample_size(F.col("good") / F.col("n"), 0.05).cast("bigint").alias("needed"))


_W = "1.96::DOUBLE"
WILSON_SQL = f"""WITH p AS (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS good, sum(quality)::DOUBLE / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n::BIGINT AS n, good::BIGINT AS good, round(greatest(0, (p + {_W} * {_W} / (2 * n) - {_W} * sqrt(p * (1 - p) / n + {_W} * {_W} / (4 * n * n))) / (1 + {_W} * {_W} / n)), 6) AS low,
 round(least(1, (p + {_W} * {_W} / (2 * n) + {_W} * sqrt(p * (1 - p) / n + {_W} * {_W} / (4 * n * n))) / (1 + {_W} * {_W} / n)), 6) AS high, ceil({_W} * {_W} * p * (1 - p) / (0.05::DOUBLE * 0.05::DOUBLE))::BIGINT AS needed FROM p"""


def pct_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the values of each kind of event."""
    at = lambda share, name: F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY value)").alias(name)
    return _events(spark, sf_dir).groupBy("event_type").agg(at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"), F.count("value").alias("n"))


PCT_SQL = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY event_type"


def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines (a prefix and a JSON object) read back: count, mean and percentiles by kind; broken lines are dropped."""
    from corvane.sources.files import parsed_log

    rows = _events(spark, sf_dir)
    line = F.concat(F.lit("INFO answer_event "), F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type", "value"))))
    parsed = parsed_log(rows.select(line.alias("value")), "answer_event ", "event_id bigint, event_type string, value double")
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("event_id").alias("last_id"))


SUMMARY_SQL = "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(event_id) AS last_id FROM events WHERE event_id % 50 <> 0 GROUP BY event_type"


def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, spending and share of urgent orders by region, without regions that have no orders."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("spent"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    per = people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("requests"), F.round(F.sum("spent") / 1000, 2).alias("cost"), F.coalesce(F.sum("urgent"), F.lit(0)).alias("urgent"))
    return per.where("requests > 0").select("r_name", "customers", "requests", "cost", D.accept_percent(F.col("urgent"), F.col("requests")).alias("urgent_percent"))


REGION_SQL = """WITH o AS (SELECT o_custkey, count(*) AS k, sum(o_totalprice) AS spent, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)
SELECT r_name, count(*) AS customers, sum(k)::BIGINT AS requests, round(sum(spent) / 1000, 2) AS cost, round_even(100.0::DOUBLE * sum(urgent) / sum(k), 0)::BIGINT AS urgent_percent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY r_name HAVING sum(k) > 0"""


def org_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations (nation and segment): members, most frequent name (ties: least), usage capped for each member,
    least positive balance, last order, and members by plan."""
    plan = F.when(F.col("c_acctbal") < 0, "none").when(F.col("c_acctbal") < 5000, "basic").otherwise("full")
    used = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("used"), F.max("o_orderdate").alias("last"))
    rows = table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("plan", plan).withColumn("name", F.substring("c_name", -1, 1))
    key = ["c_nationkey", "c_mktsegment"]
    names = rows.groupBy(*key, "name").agg(F.count(F.lit(1)).alias("k")).groupBy(*key).agg(F.max_by("name", F.struct("k", -F.ascii("name"))).alias("name"))
    per = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.least(F.coalesce("used", F.lit(0)), F.lit(12))).alias("used"),
        F.min(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("least_balance"),
        F.max("last").alias("last_order"),
        *[F.count_if(F.col("plan") == p).alias(f"n_{p}") for p in ("none", "basic", "full")],
    )
    return per.join(names, key)


ORG_SQL = """WITH u AS (SELECT o_custkey, count(*) AS used, max(o_orderdate) AS last FROM orders GROUP BY 1),
r AS (SELECT *, right(c_name, 1) AS name, CASE WHEN c_acctbal < 0 THEN 'none' WHEN c_acctbal < 5000 THEN 'basic' ELSE 'full' END AS plan FROM customer LEFT JOIN u ON o_custkey = c_custkey),
n AS (SELECT c_nationkey, c_mktsegment, name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY count(*) DESC, name) AS rn FROM r GROUP BY 1, 2, 3)
SELECT c_nationkey, c_mktsegment, count(*) AS members, sum(least(coalesce(used, 0), 12))::BIGINT AS used, min(c_acctbal) FILTER (WHERE c_acctbal > 0) AS least_balance, max(last) AS last_order,
 count(*) FILTER (WHERE plan = 'none') AS n_none, count(*) FILTER (WHERE plan = 'basic') AS n_basic, count(*) FILTER (WHERE plan = 'full') AS n_full, max(n.name) AS name
FROM r JOIN n USING (c_nationkey, c_mktsegment) WHERE rn = 1 GROUP BY 1, 2"""


def period_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer in the monthly period that holds a given day, counted from the customer's first order."""
    now = F.lit("1998-06-15").cast("date")
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("anchor"))
    k, start = D.period_start(F.col("anchor"), now)
    periods = first.where(F.col("anchor") <= now).select("o_custkey", "anchor", k.cast("bigint").alias("period"), start.alias("start"), F.add_months("anchor", k + 1).alias("stop"))
    used = periods.join(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "o_custkey").groupBy("o_custkey", "period", "start", "stop").agg(F.count_if((F.col("day") >= F.col("start")) & (F.col("day") < F.col("stop"))).alias("used"))
    return used.withColumn("left", F.greatest(F.lit(3) - F.col("used"), F.lit(0)))


PERIOD_SQL = """WITH a AS (SELECT o_custkey, min(o_orderdate)::DATE AS anchor FROM orders GROUP BY 1 HAVING min(o_orderdate)::DATE <= DATE '1998-06-15'),
m AS (SELECT *, (1998 - year(anchor)) * 12 + 6 - month(anchor) AS months FROM a),
k AS (SELECT *, greatest(months - CASE WHEN anchor + to_months(months::INTEGER) > DATE '1998-06-15' THEN 1 ELSE 0 END, 0) AS period FROM m),
p AS (SELECT o_custkey, period, (anchor + to_months(period::INTEGER))::DATE AS start, (anchor + to_months((period + 1)::INTEGER))::DATE AS stop FROM k)
SELECT o_custkey, period::BIGINT AS period, start, stop, count(*) FILTER (WHERE o_orderdate::DATE >= start AND o_orderdate::DATE < stop) AS used, greatest(3 - count(*) FILTER (WHERE o_orderdate::DATE >= start AND o_orderdate::DATE < stop), 0) AS "left" FROM p JOIN orders USING (o_custkey) GROUP BY 1, 2, 3, 4"""


def recency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by recency on a given day."""
    today = F.lit("2024-01-18").cast("date")
    bucket = D.recency(D.local_day(F.col("ts")), today)
    return _events(spark, sf_dir).where(D.local_day(F.col("ts")) <= today).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


RECENCY_SQL = """SELECT CASE WHEN d = DATE '2024-01-18' THEN 'today' WHEN d = DATE '2024-01-17' THEN 'yesterday' WHEN date_trunc('week', d) = DATE '2024-01-15' THEN 'week' ELSE 'earlier' END AS bucket, count(*) AS n FROM (SELECT (ts + INTERVAL 3 HOURS)::DATE AS d FROM events) WHERE d <= DATE '2024-01-18' GROUP BY 1"""


def command_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of every known command, unused ones included: runs, mean value, errors in percent of the runs."""
    known = spark.createDataFrame([(k, t) for k, t in (("click", "Click"), ("view", "View"), ("purchase", "Purchase"), ("signup", "Sign up"), ("export", "Export"))], "event_type string, title string")
    per = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") < 5).alias("bad"))
    return known.join(per, "event_type", "left").select("event_type", "title", F.coalesce("runs", F.lit(0)).alias("runs"), "mean", D.accept_percent(F.col("bad"), F.col("runs")).alias("bad_percent"))


COMMAND_SQL = """WITH k(event_type, title) AS (VALUES ('click', 'Click'), ('view', 'View'), ('purchase', 'Purchase'), ('signup', 'Sign up'), ('export', 'Export'))
SELECT k.event_type, title, count(e.event_id) AS runs, round(avg(value), 4) AS mean, CASE WHEN count(e.event_id) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (WHERE value < 5) / count(e.event_id), 0)::BIGINT END AS bad_percent FROM k LEFT JOIN events e USING (event_type) GROUP BY 1, 2"""


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency by day, withheld on days with more than two failures of the kind that makes them invalid."""
    per = _events(spark, sf_dir).groupBy(D.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 30)).alias("invalid"), F.avg("value").alias("m"))
    return per.select("day", "n", "invalid", F.when(F.col("invalid") <= 2, F.round("m", 4)).alias("mean"))


FAILURE_SQL = "SELECT (ts + INTERVAL 3 HOURS)::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error' AND value > 30) AS invalid, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value > 30) <= 2 THEN round(avg(value), 4) END AS mean FROM events GROUP BY 1"


def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low ratings, worst first and latest first among equals."""
    rows = _events(spark, sf_dir).withColumn("rating", F.floor(F.col("value") % 6)).where("rating <= 2 AND event_type = 'purchase'")
    return rows.orderBy("rating", F.desc("ts"), "event_id").limit(50).select("event_id", "rating", "ts")


WORST_SQL = "SELECT event_id, floor(value % 6)::BIGINT AS rating, ts FROM events WHERE floor(value % 6) <= 2 AND event_type = 'purchase' ORDER BY rating, ts DESC, event_id LIMIT 50"


def expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose plan (a year from the last order) ends within seven days of a given day or has ended."""
    now = F.lit("1998-09-01").cast("date")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    ends = per.withColumn("expires", F.add_months("last", 12)).withColumn("days", F.datediff("expires", now).cast("bigint"))
    return ends.where("days <= 7").select("o_custkey", "expires", "days", (F.col("days") < 0).alias("expired"))


EXPIRING_SQL = "SELECT * FROM (SELECT o_custkey, (max(o_orderdate)::DATE + INTERVAL 12 MONTHS)::DATE AS expires, ((max(o_orderdate)::DATE + INTERVAL 12 MONTHS)::DATE - DATE '1998-09-01')::BIGINT AS days, ((max(o_orderdate)::DATE + INTERVAL 12 MONTHS)::DATE - DATE '1998-09-01') < 0 AS expired FROM orders GROUP BY 1) WHERE days <= 7"


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge of events older than twenty days would leave and take, by kind."""
    old = F.col("ts") < F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 20 DAYS")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


RETENTION_SQL = "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS purged, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS kept FROM events GROUP BY 1"


def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the user's events of the hour before it; one just an hour old no longer counts."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_599_999_999, 0)
    return _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


SLIDING_SQL = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS n FROM events"


def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events admitted under a cap of two a user and day and of two hundred a day for all (in the order of time)."""
    day = D.local_day(F.col("ts"))
    rows = _events(spark, sf_dir).withColumn("day", day).withColumn("of_user", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))).where("of_user <= 2")
    return rows.withColumn("of_day", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))).where("of_day <= 200").select("event_id", "day", "of_user", "of_day")


CAP_SQL = "SELECT event_id, day, of_user, of_day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS of_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS of_user FROM (SELECT *, (ts + INTERVAL 3 HOURS)::DATE AS day FROM events)) WHERE of_user <= 2) WHERE of_day <= 200"


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each user's last signup event, flagged from ten on; users without one are flagged too."""
    per = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.to_date("ts"))).alias("last"))
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.col("last")).cast("bigint")
    return per.select("user_id", "last", days.alias("days"), F.coalesce(days >= 10, F.lit(True)).alias("silent"))


SILENCE_SQL = "SELECT user_id, last, (DATE '2024-01-31' - last)::BIGINT AS days, coalesce(DATE '2024-01-31' - last >= 10, true) AS silent FROM (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN ts::DATE END) AS last FROM events GROUP BY 1)"


def operations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: today's and this month's requests, users, errors and cost."""
    day, today = D.local_day(F.col("ts")), F.lit("2024-01-20").cast("date")
    month = F.trunc(day, "month") == F.trunc(today, "month")
    rows = _events(spark, sf_dir).where(day <= today)
    return rows.agg(
        F.count_if(day == today).alias("today"),
        F.count_if(month).alias("month"),
        F.countDistinct(F.when(day == today, F.col("user_id"))).alias("users_today"),
        F.countDistinct(F.when(month, F.col("user_id"))).alias("users_month"),
        F.count_if((day == today) & (F.col("event_type") == "error")).alias("errors_today"),
        F.round(F.sum(F.when(month, F.col("value"))) * 0.002, 4).alias("cost_month"),
    )


OPERATIONS_SQL = "SELECT count(*) FILTER (WHERE d = DATE '2024-01-20') AS today, count(*) FILTER (WHERE d >= DATE '2024-01-01') AS month, count(DISTINCT user_id) FILTER (WHERE d = DATE '2024-01-20') AS users_today, count(DISTINCT user_id) FILTER (WHERE d >= DATE '2024-01-01') AS users_month, count(*) FILTER (WHERE d = DATE '2024-01-20' AND event_type = 'error') AS errors_today, round(sum(value) FILTER (WHERE d >= DATE '2024-01-01') * 0.002::DOUBLE, 4) AS cost_month FROM (SELECT *, (ts + INTERVAL 3 HOURS)::DATE AS d FROM events) WHERE d <= DATE '2024-01-20'"

QUERIES = {
    "user_activity": (user_activity, ACTIVITY_SQL),
    "event_flags": (event_flags, FLAGS_SQL),
    "acceptance": (acceptance, ACCEPT_SQL),
    "rating_histogram": (rating_histogram, HISTOGRAM_SQL),
    "daily_series": (daily_series, DAILY_SQL),
    "trends": (trends, TREND_SQL),
    "latest_wins": (latest_wins, LATEST_SQL),
    "rating_status": (rating_status, STATUS_SQL),
    "grouping_sets": (grouping_sets, SETS_SQL),
    "wilson": (wilson, WILSON_SQL),
    "pct_nearest_rank": (pct_nearest_rank, PCT_SQL),
    "event_summary": (event_summary, SUMMARY_SQL),
    "region_rollup": (region_rollup, REGION_SQL),
    "org_rollup": (org_rollup, ORG_SQL),
    "period_usage": (period_usage, PERIOD_SQL),
    "recency_bucket": (recency_bucket, RECENCY_SQL),
    "command_usage": (command_usage, COMMAND_SQL),
    "failure_report": (failure_report, FAILURE_SQL),
    "worst_first": (worst_first, WORST_SQL),
    "expiring": (expiring, EXPIRING_SQL),
    "retention": (retention, RETENTION_SQL),
    "sliding_count": (sliding_count, SLIDING_SQL),
    "daily_cap": (daily_cap, CAP_SQL),
    "silence": (silence, SILENCE_SQL),
    "operations_summary": (operations_summary, OPERATIONS_SQL),
}
