"""Outside calls: once for each distinct key, from the cache, with errors kept apart, also when a task fails."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import calls


def counting(folder, bad=(), fail_once=None):
    """A client that notes each key it is asked for in a file of its own."""

    def client():
        def ask(keys):
            if fail_once and not os.path.exists(fail_once):
                open(fail_once, "w").close()
                os._exit(1)  # the worker dies: the task is run again
            if any(k in bad for k in keys):
                raise RuntimeError("bad " + ",".join(k for k in keys if k in bad))
            for k in keys:
                with open(f"{folder}/asked", "a") as f:
                    f.write(k + "\n")
            return [[float(len(k)), float(k.count("e"))] for k in keys]

        return ask

    return client


def asked(folder):
    return sorted(open(f"{folder}/asked").read().split("\n")[:-1]) if os.path.exists(f"{folder}/asked") else []


def test_once_for_each_key_and_from_the_cache(spark, tmp_path):
    keys = [f"key {i}" for i in range(50)]
    rows = spark.createDataFrame([(i, keys[i % 50] if i % 3 else keys[0]) for i in range(600)] + [(999, None)], "id bigint, text string").repartition(6)
    path = str(tmp_path / "cache")
    got = calls.called(rows, "text", counting(tmp_path), "array<double>", path, batch=7).collect()
    assert asked(tmp_path) == sorted(keys) and len(got) == 601
    assert all(r.value == ([float(len(r.text)), float(r.text.count("e"))] if r.text else None) and r.error is None for r in got)
    more = rows.unionByName(spark.createDataFrame([(1000, "new one")], rows.schema))
    assert calls.called(more, "text", counting(tmp_path), "array<double>", path).where("value IS NULL").count() == 1
    assert asked(tmp_path) == sorted([*keys, "new one"])
    assert calls.called(rows.limit(0), "text", counting(tmp_path), "array<double>", path).count() == 0
    assert calls.called(rows.limit(0), "text", counting(tmp_path), "array<double>", str(tmp_path / "other")).count() == 0


def test_errors_cost_no_other_key_and_are_not_cached(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "PAUSE", 0)
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(20)], "id bigint, text string").coalesce(1)
    path = str(tmp_path / "cache")
    first = {r.text: (r.value, r.error) for r in calls.called(rows, "text", counting(tmp_path, bad=("k3", "k11")), "array<double>", path).collect()}
    assert {k for k, (v, e) in first.items() if e} == {"k3", "k11"} and first["k3"] == (None, "RuntimeError: bad k3") and first["k4"][0] == [2.0, 0.0]
    again = {r.text: (r.value, r.error) for r in calls.called(rows, "text", counting(tmp_path), "array<double>", path).collect()}
    assert not any(e for _, e in again.values()) and asked(tmp_path).count("k4") == 1 and asked(tmp_path).count("k3") == 1


def test_retry_gives_a_late_answer():
    tries = []

    def ask(keys):
        tries.append(keys)
        if len(tries) < 3:
            raise OSError("busy")
        return keys

    assert calls.tried(ask, [1, 2], pause=0) == [(1, None), (2, None)] and len(tries) == 3
    assert calls.tried(lambda keys: [], [1], tries=1) == [(None, "ValueError: 0 values for 1 keys")]


@pytest.fixture()
def retrying():
    """A session of its own process that runs a failed task again."""
    import subprocess
    import sys

    def run(code):
        return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)

    return run


def test_a_lost_task_is_run_again(retrying, tmp_path):
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from corvane.operators import calls
from tests.test_calls import counting
rows = spark.createDataFrame([(i, f"k{{i % 9}}") for i in range(90)], "id bigint, text string")
got = calls.called(rows, "text", counting({str(tmp_path)!r}, fail_once={str(tmp_path / "died")!r}), "array<double>", {str(tmp_path / "cache")!r})
assert got.where("value IS NOT NULL AND error IS NULL").count() == 90
assert spark.read.parquet({str(tmp_path / "cache")!r}).count() == 9
"""
    out = retrying(code)
    assert out.returncode == 0, out.stderr[-2000:]
    assert os.path.exists(tmp_path / "died")
