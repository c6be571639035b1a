"""Dialog and event analytics: as-of turns, session rollups, latest-wins, trends, intervals and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours that local days lie ahead of UTC (fixed, without daylight rules).
LOCAL_HOURS = 3


def local_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(f"INTERVAL {LOCAL_HOURS} HOURS"))


def in_local_days(ts: Column, since: str | None, until: str | None) -> Column:
    """Inclusive window of local days; rows without a time pass only if there is no bound at all."""
    if since is None and until is None:
        return F.lit(True)
    day = local_day(ts)
    inside = F.lit(True)
    if since is not None:
        inside = inside & (day >= F.lit(since).cast("date"))
    if until is not None:
        inside = inside & (day <= F.lit(until).cast("date"))
    return ts.isNotNull() & inside


def optional_filters(df: DataFrame, *, user: int | None = None, since: str | None = None, until: str | None = None, ids: list | None = None) -> DataFrame:
    """Each filter holds only if it is given; times are half-open."""
    if user is not None:
        df = df.where(F.col("user_id") == user)
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col("ts") < F.lit(until).cast("timestamp"))
    if ids is not None:
        df = df.where(F.col("user_id").isin(ids))
    return df


def asof_question(turns: DataFrame) -> DataFrame:
    """Add to each assistant turn the nearest user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return turns.withColumn("_q", F.last(asked, ignorenulls=True).over(w)).where("role = 'assistant'").select("conv_id", "turn", F.col("_q.turn").alias("question_turn"), F.col("_q.text").alias("question"))


def asof_answer(turns: DataFrame) -> DataFrame:
    """Add to each user turn the first assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.withColumn("answer_turn", F.first(answer, ignorenulls=True).over(w)).where("role = 'user'").select("conv_id", "turn", "answer_turn")


def unanswered(turns: DataFrame) -> DataFrame:
    """User turns that another user turn or nothing follows."""
    following = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    talk = turns.where(F.col("role").isin("user", "assistant")).withColumn("next_role", following)
    return talk.where("role = 'user' AND NOT next_role <=> 'assistant'").select("conv_id", "turn", "next_role")


def last_n(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def accept_percent(hits: Column, total: Column) -> Column:
    """Whole percent rounded half to even; null for nothing."""
    return F.when(total > 0, F.bround(100.0 * hits / total, 0)).cast("bigint")


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, with the number of rows it stands for."""
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rn", last).withColumn("n_rows", F.count(F.lit(1)).over(w)).where("_rn = 1").drop("_rn")


def trend(current: Column, previous: Column) -> Column:
    """'new' if there was nothing before, else the signed change in percent (half to even); null if both are zero."""
    change = F.bround(100.0 * (current - previous) / previous, 0).cast("bigint")
    return F.when((previous == 0) & (current == 0), None).when(previous == 0, "new").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string"), F.lit("%")))


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; zero for nothing."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)
    return F.when(n.isNotNull(), low).otherwise(0.0), F.when(n.isNotNull(), high).otherwise(0.0)


def sample_size(share: Column, half_width: float, z: float = 1.96) -> Column:
    return F.ceil(z * z * share * (1 - share) / (half_width * half_width))


def period_start(anchor: Column, now: Column) -> tuple[Column, Column]:
    """Number of whole months since the anchor (not negative) and the start of the period that holds ``now``.

    Periods are counted from the anchor itself, so a short month doesn't move later ones.
    """
    months = (F.year(now) - F.year(anchor)) * 12 + F.month(now) - F.month(anchor)
    k = F.greatest(months - (F.add_months(anchor, months) > now).cast("int"), F.lit(0))
    return k, F.add_months(anchor, k)


def recency(day: Column, today: Column) -> Column:
    """today (or later), yesterday, week (the same ISO week) or earlier."""
    same_week = F.trunc(day, "week") == F.trunc(today, "week")
    return F.when(day >= today, "today").when(F.datediff(today, day) == 1, "yesterday").when(same_week, "week").otherwise("earlier")


def gaps(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add ``run``: the number of the run of equal neighbouring values within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("_new").over(w)).drop("_new")
