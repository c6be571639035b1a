"""Caps together, refunds and windows beside a sequential version; a stream in batches beside the whole."""

import datetime as dt
import random

from corvane.operators import admission
from corvane.operators.admission import Cap

CAPS = [Cap("personal", "guest", 4), Cap("daily", "to_date(ts)", 18), Cap("address", "addr", 3, window=6 * 3600.0, refunds=False)]
SCHEMA = "event_id bigint, ts timestamp, guest string, addr int, refund_ts timestamp"
START = dt.datetime(2024, 1, 1)


def sequential(rows):
    out, taken = {}, []
    for i, ts, guest, addr, refund in sorted(rows, key=lambda r: (r[1], r[0])):
        held = [t for t in taken if t[3] is None or t[3] > ts]
        full = [
            ("personal", sum(t[1] == guest for t in held) >= 4),
            ("daily", sum(t[0].date() == ts.date() for t in held) >= 18),
            ("address", sum(t[2] == addr and t[0] > ts - dt.timedelta(hours=6) for t in taken) >= 3),
        ]
        out[i] = next((name for name, is_full in full if is_full), "admitted")
        if out[i] == "admitted":
            taken.append((ts, guest, addr, refund))
    return out


def requests(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = START + dt.timedelta(minutes=rng.randrange(4 * 1440)) if rng.random() < 0.9 else START + dt.timedelta(hours=5)
        refund = ts + dt.timedelta(minutes=rng.choice([0, 10, 300])) if rng.random() < 0.2 else None
        rows.append((i, ts, rng.choice([None, *"abcdefghijklmnopqrstuvwxyz", "hot", "hot", "hot"]), rng.randrange(12), refund))
    return rows


def test_caps_together(spark):
    rows = requests(1, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.event_id: r.verdict for r in admission.admitted(df, CAPS).collect()}
    assert got == sequential(rows) and set(got.values()) == {"admitted", "personal", "daily", "address"}
    assert admission.admitted(df.limit(0), CAPS).count() == 0


def test_many_blocks_of_time(spark):
    """Blocks of few requests, so that places and refunds pass their borders; few rounds even so."""
    rows = requests(3, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with_rounds = []
    whole, admission._round = admission._round, lambda *a: (with_rounds.append(1), whole(*a))[1]
    try:
        got = {r.event_id: r.verdict for r in admission.admitted(df, CAPS, block=40).collect()}
    finally:
        admission._round = whole
    assert got == sequential(rows) and len(with_rounds) <= 9


def test_stream_equals_the_whole(spark, tmp_path):
    rows = sorted(requests(2, 75), key=lambda r: (r[1], r[0]))
    for n, lo in enumerate(range(0, 75, 25)):
        spark.createDataFrame(rows[lo : lo + 25], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    admission.admit_stream(stream, CAPS, out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    judged = admission.history(spark, out)
    assert judged.select("epoch").distinct().count() == 3
    assert {r.event_id: r.verdict for r in judged.collect()} == sequential(rows)
