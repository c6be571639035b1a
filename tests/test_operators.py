"""Operators on small literal tables, with the cases that matter."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import guards as G
from corvane.functions import text as T
from corvane.operators import codes as C
from corvane.operators import dialog as D
from corvane.operators import integrity as I
from corvane.operators import retrieval as R
from corvane.streaming import limits as L


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_tied_scores_share_their_places(spark):
    lists = spark.createDataFrame([(1, "x", 10, 0.9), (1, "x", 20, 0.5), (1, "x", 30, 0.5), (1, "y", 20, 0.7), (1, "y", 30, 0.7)], "query_id int, list_id string, item_id int, score double")
    shares = {(r.list_id, r.item_id): r.share for r in R.tied_shares(lists).collect()}
    assert shares["x", 10] == pytest.approx(0.5)
    assert shares["x", 20] == shares["x", 30] == pytest.approx((1 / 3 + 1 / 4) / 2)
    fused = {r.item_id: r.score for r in R.fused(lists, 5).collect()}
    assert fused[20] == fused[30] == pytest.approx(0.708333, abs=1e-6)


def test_quota_window_takes_turns_then_fills(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("aaaabbc")], "query_id int, doc string, rank int")
    quota = F.when(F.col("doc") == "a", 2).otherwise(1)
    places = lambda df: [(r.doc, r.rank) for r in df.orderBy("place").collect()]
    # the choice goes round by round, the order of what was chosen by rank
    assert places(R.quota_window(ranked, "doc", quota, 6)) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("c", 7)]
    assert places(R.quota_window(ranked, "doc", quota, 4)) == [("a", 1), ("a", 2), ("b", 5), ("c", 7)]
    # with two places the subject's document has the first claim, and its rows stand first
    own = F.col("doc") == "c"
    assert places(R.quota_window(ranked, "doc", quota, 2, [~own, F.col("doc")], [~own])) == [("c", 7), ("a", 1)]


def test_lists_are_capped_reordered_and_extended(spark):
    rows = spark.createDataFrame([(1, i, i in (1, 5), w) for i, w in enumerate(["x", "head", "b c", "c", "d", "head", "b"])], "q int, pos int, heading boolean, words string")
    got = R.capped(rows, ["q"], ["pos"], 3, "heading").orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 1, 2, 3, 5] and {(r.total, r.rest) for r in got} == {(5, 2)}
    words = rows.withColumn("w", F.split("words", " ")).withColumn("qw", F.array(F.lit("b"), F.lit("c")))
    placed = R.reordered(words, ["q"], "heading", "w", "qw", "pos").orderBy("place").collect()
    assert [r.pos for r in placed] == [2, 3, 6, 0, 4, 1, 5]
    window = spark.createDataFrame([(1, i, n + 1, i == 12) for n, i in enumerate((10, 11, 12, 13))], "query_id int, item_id int, rank int, matched boolean")
    extra = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (2, 5, 1)], "query_id int, item_id int, rank int")
    got = [(r.item_id, r.matched) for r in R.inserted(window, extra, 4).where("query_id = 1").orderBy("place").collect()]
    assert got == [(10, False), (11, True), (12, True), (99, True)]
    codes = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c"])], "i int, codes array<string>")
    assert [r.i for r in R.match_any(codes, "codes", ["b", "c"]).collect()] == [1, 4] and R.match_any(codes, "codes", []).count() == 0


def test_sensitive_kinds(spark):
    data = {
        "snils 112-233-445 95": "snils", "number 111-111-111 45 and 222-222-222 90": "", "inn 500100732259": "inn_person", "inn 500100732258": "",
        "card 4111 1111 1111 1111 end": "card", "card 4111-1111-1111-1112": "", "паспорт серия 4611 123456": "passport", "4611 123456": "",
        "это СЕКРЕТНО": "restricted", "секретность": "", "коммерческая тайна": "restricted", "звоните +7 495 123-45-67": "phone", "код 8544 49 910 0": "",
        "8 (4712) 55-12-34": "phone", "a.b@c.org": "email", "": "", "host 10.0.0.1": "address",
    }
    df = spark.createDataFrame([(t,) for t in data], "t string").select("t", F.array_join(G.sensitive_kinds(F.col("t")), ",").alias("k"), F.lower("t").rlike(G.SUSPICIOUS).alias("s"))
    got = {r.t: r for r in df.collect()}
    assert {t: r.k for t, r in got.items()} == data and all(r.s for r in got.values() if r.k)
    assert set(G.BLOCKING) == {"restricted", "passport", "snils", "inn_person", "card"}


def test_excerpts_are_one_plain_line(spark):
    data = [("# Head\n| a | b |\n- one **bold** `code` [1].\n\n_it_ and snake_case_name [2, 3] , end", 99, "Head one bold code. it and snake_case_name, end"), ("x" * 220, 220, "x" * 220), ("y" * 300, 220, "y" * 219 + "…"), ("word " * 60, 20, "word word word word…"), ("", 5, ""), (None, 5, None)]
    for text, most, want in data:
        assert spark.createDataFrame([(text,)], "t string").select(T.excerpt(F.col("t"), most)).first()[0] == want


def test_a_refresh_keeps_keys_of_several_scopes(spark):
    schema = "s string, k int, v string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), (None, 5, "n")], schema)
    new = spark.createDataFrame([("a", 1, "new"), ("a", 1, "newer"), ("c", 1, "z"), (None, 6, "n")], schema)
    assert {tuple(r) for r in I.upserted(old, new, "k", "s").collect()} == {("b", 1, "x"), ("a", 1, "new"), ("c", 1, "z"), (None, 6, "n")}


def test_days_ahead_are_today(spark):
    df = spark.sql("SELECT explode(array(date'2024-02-01', date'2024-01-31', date'2024-01-30', date'2024-01-29', date'2024-01-28')) AS d")
    assert [r[0] for r in df.select(D.recency(F.col("d"), F.lit("2024-01-31").cast("date"))).collect()] == ["today", "today", "yesterday", "week", "earlier"]


def test_bm25_reads_documents_once_and_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, None), (4, "the long green word")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "red fish fish"), (8, "absent")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id): r.score for r in R.bm25(docs, asked, "doc_id", "item_id").collect()}
    n, avgdl = 4, (3 + 2 + 0 + 4) / 4
    part = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got == {(7, 1): pytest.approx(part(2, 1, 3) + 2 * part(1, 2, 3)), (7, 2): pytest.approx(2 * part(1, 2, 2))}


def test_nearest_ancestor_only_without_descendants(spark):
    hits = spark.createDataFrame([(1, -2), (1, -1), (1, None), (2, -1), (2, 3), (3, 0)], "query_id int, relation int")
    got = {(r.query_id, r.relation): r.tier for r in R.code_tiers(hits).collect()}
    assert got == {(1, -2): 3, (1, -1): 2, (1, None): 3, (2, -1): 3, (2, 3): 1, (3, 0): 0}


def test_code_key_trims_zeros_of_a_fourth_segment(spark):
    df = spark.createDataFrame([("26.20.40.190",), ("26.20.40.100",), ("26.20",), ("26.20.40.10",), ("30",)], "c string")
    assert [r[0] for r in df.select(C.key(F.col("c"))).collect()] == ["26204019", "2620401", "2620", "26204010", "30"]


def test_ranges_in_three_values(spark):
    df = spark.createDataFrame([("26", "261", "263"), ("262", "261", "263"), ("2639", "261", "263"), ("264", "261", "263"), ("2", "261", "263"), ("26", "26", None), ("27", "26", None)], "c string, low string, high string")
    assert [r[0] for r in df.select(C.in_range(F.col("c"), F.col("low"), F.col("high"))).collect()] == ["narrower", "exact", "exact", "none", "narrower", "exact", "none"]


def test_periods_count_from_the_anchor(spark):
    cases = [("2024-01-31", "2024-02-28", 0, "2024-01-31"), ("2024-01-31", "2024-02-29", 1, "2024-02-29"), ("2024-01-31", "2024-03-30", 1, "2024-02-29"), ("2024-01-31", "2024-03-31", 2, "2024-03-31"), ("2024-05-10", "2024-05-01", 0, "2024-05-10")]
    for anchor, now, k, start in cases:
        n, s = D.period_start(F.lit(anchor).cast("date"), F.lit(now).cast("date"))
        assert tuple(spark.range(1).select(n, s).first()) == (k, dt.date.fromisoformat(start))


def test_percent_and_trend(spark):
    df = spark.createDataFrame([(1, 8, 0), (3, 8, 2), (0, 0, 0), (5, 40, 10)], "a int, b int, c int")
    out = df.select(D.accept_percent(F.col("a"), F.col("b")), D.trend(F.col("a"), F.col("c"))).collect()
    assert [tuple(r) for r in out] == [(12, "new"), (38, "+50%"), (None, None), (12, "-50%")]


def test_wilson_bounds(spark):
    low, high = D.wilson(F.lit(9), F.lit(10))
    none = D.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(low, high, *none).first()
    assert r[0] == pytest.approx(0.5958, abs=1e-3) and r[1] == pytest.approx(0.9821, abs=1e-3) and tuple(r)[2:] == (0.0, 0.0)


def test_check_digits(spark):
    df = spark.createDataFrame([("7707083893", True), ("7707083894", False), ("500100732259", True), ("12", False), (None, False)], "n string, good boolean")
    assert all(r[0] == r[1] for r in df.select(G.inn_valid(F.col("n")), "good").collect())
    r = spark.range(1).select(G.snils_valid(F.lit("112-233-445 95")), G.snils_valid(F.lit("111-111-111 11")), G.card_valid(F.lit("4111 1111 1111 1111")), G.card_valid(F.lit("4111111111111112"))).first()
    assert tuple(r) == (True, False, True, False)


def test_topics(spark):
    df = spark.createDataFrame([("a a b",), ("a b",), ("",)], "t string")
    assert [r[0] for r in df.select(G.best_topic(F.col("t"), [("x", "a"), ("y", "b")])).collect()] == ["x", None, None]
    assert [r[0] for r in df.select(G.first_topic(F.col("t"), [("y", "b"), ("x", "a")])).collect()] == ["y", "y", None]


def test_ngrams_and_coverage(spark):
    r = spark.range(1).select(T.ngrams(F.split(F.lit("a b c"), " "), 2), T.ngrams(F.array(F.lit("a")), 2), G.coverage(F.array().cast("array<string>"), F.array(F.lit("x"))), G.coverage(F.array(F.lit("x"), F.lit("y"), F.lit("x")), F.array(F.lit("x")))).first()
    assert tuple(r) == (["a b", "b c"], [], 1.0, 0.5)


def test_multiset_difference(spark):
    one, two = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string"), spark.createDataFrame([("x",), ("z",), (None,)], "v string")
    assert rows(I.multiset_difference(one, two), "v") == [("x", "left", 1), ("y", "left", 1), ("z", "right", 1)]


def test_changed_rows_refuses_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(I.changed_rows(one, spark.createDataFrame([(2, "b"), (3, None)], "k int, v string"), "k", ["v"]), "k") == [(1, "removed", None), (2, "changed", "v"), (3, "added", None)]
    with pytest.raises(ValueError):
        I.changed_rows(one.union(one), one, "k", ["v"])


def test_null_status_passes_a_negated_filter(spark):
    df = spark.createDataFrame([("retired",), ("active",), (None,)], "status string")
    assert df.where("NOT status <=> 'retired'").count() == 2


def test_limiter_rejects_without_taking_a_place():
    kept, out = [], []
    for ts in (0, 1, 2, 9.5, 10, 11, 12):
        ok, retry, kept = L.admit(kept, ts, 2, 10)
        out.append((ok, retry))
    assert out == [(True, 0.0), (True, 0.0), (False, 8), (False, 0.5), (True, 0.0), (True, 0.0), (False, 8)]


def test_limiter_stream_is_the_same_as_the_batch(spark, tmp_path):
    data = [(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = L.limited_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user_id", 2, 60.0)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    assert query.awaitTermination(60)
    assert rows(spark.table("limited"), "event_id") == rows(L.limited_batch(df, "user_id", 2, 60.0), "event_id")


def test_scope_writer_can_be_replayed(spark, tmp_path):
    write = L.write_by_scope(f"{tmp_path}/t", "scope")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id int, scope string")
    write(batch, 0)
    write(batch.where("scope = 'a'"), 1)
    write(batch.where("scope = 'a'"), 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
