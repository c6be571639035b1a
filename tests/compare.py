"""Run queries on Spark and their SQL on DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import glob
import hashlib
import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session(cpus: int = 8, memory: str = "6g"):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the workers
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def oracle(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(x) -> str:
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6f}"
    if hasattr(x, "tolist"):
        return canonical(x.tolist())
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canonical, x)) + "]"
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    if hasattr(x, "as_tuple"):
        return f"{float(x):.6f}"
    return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(mine)} rows, no SQL"
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if mine != theirs:
        extra, missing = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return False, f"{len(mine)} != {len(theirs)} rows or values: only Spark {extra}, only SQL {missing}"
    return True, f"{len(mine)} rows, {hashlib.md5(repr(mine).encode()).hexdigest()[:8]}"


if __name__ == "__main__":
    import time

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con, sqls = session(), oracle(sf), e.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in e.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            ok, said = compare(spark, con, name, q, sqls.get(name), sf)
        except Exception as err:
            ok, said = False, "\n".join(str(err).splitlines()[:12])[:1500]
        bad += not ok
        print("ok  " if ok else "FAIL", name, said, f"{time.time() - t:.1f} s", flush=True)
    print("failures:", bad)
