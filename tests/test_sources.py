"""Readers and writers on small files."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import files, sinks
from corvane.sources.files import rtf_text, table_grid


def test_json_records_and_manifest(spark, tmp_path):
    for name, rows in (("a1", [{"x": 1}, {"x": 2}]), ("a2", [{"x": 3}]), ("a_old", [{"x": 9}]), ("b1", [{"x": 4}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    assert sorted(r.x for r in files.json_records(spark, f"{tmp_path}/a[12].json", "x int").collect()) == [1, 2, 3]
    schema = "doc_type string, path string, excluded array<string>, status string"
    good = spark.createDataFrame([("a", "a*.json", ["%old*"], "active"), ("b", "b*.json", None, "active"), ("c", "none*.json", None, "retired")], schema)
    rows = files.manifest_records(spark, good, str(tmp_path), "x int").collect()
    assert sorted((r.doc_type, r.x) for r in rows) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]
    with pytest.raises(ValueError):
        files.manifest_records(spark, spark.createDataFrame([("a", "a1.json", None, "active"), ("a", "a2.json", None, "active")], schema), str(tmp_path), "x int")


def test_tsv_drops_broken_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tone\nbroken\n2\ttwo\n")
    assert [tuple(r) for r in files.tsv(spark, f"{tmp_path}/c.tsv", "code int, name string").orderBy("code").collect()] == [(1, "one"), (2, "two")]


def test_log_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text('INFO event {"a": 1}\nno mark {"a": 2}\nWARN event {"a": broken\nINFO event {"a": 3, "b": 4}\n')
    assert sorted(r.a for r in files.log_events(spark, f"{tmp_path}/x.log", "event ", "a int").collect()) == [1, 3]


def test_xlsx_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>va</t><t>lue</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="C2"><v>7</v></c><c r="D2"/></row></sheetData></worksheet>')
    got = sorted((r.row, r.col, r.text) for r in files.xlsx_cells(spark, f"{tmp_path}/t.xlsx").collect())
    assert got == [(1, "A", "name"), (1, "C", "value"), (2, "C", "7")]


def test_rtf_text(spark, tmp_path):
    raw = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard \'cf\'f0\'e8\'e2\'e5\'f2 \b x\b0\par\par second\par}"
    assert rtf_text(raw) == "Привет x\nsecond"
    (tmp_path / "a.rtf").write_bytes(raw)
    assert files.rtf_files(spark, f"{tmp_path}/a.rtf").first().text == "Привет x\nsecond"


def test_table_grid_with_spans():
    html = "<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d</table><table><tr><th>e</table>"
    assert table_grid(html) == [(0, 0, 0, "a", 0, False), (0, 0, 1, "b", 1, False), (0, 0, 2, "", 1, True), (0, 1, 0, "", 0, True), (0, 1, 1, "c", 2, False), (0, 1, 2, "d", 3, False), (1, 0, 0, "e", 4, False)]
    assert table_grid(None) == table_grid("no table") == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x;y"), (2, "b", None)], "id int, scope string, t string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    text = "".join(open(f"{tmp_path}/csv/{f}", encoding="utf-8").read() for f in sorted(os.listdir(f"{tmp_path}/csv")) if f.startswith("part"))
    assert text.startswith("﻿id;scope;t") and '"x;y"' in text
    sinks.replace_scopes(df, f"{tmp_path}/t", "scope")
    sinks.replace_scopes(df.where("scope = 'b'").withColumn("id", F.lit(5)), f"{tmp_path}/t", "scope")
    assert sorted((r.id, r.scope) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (5, "b")]
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.write_texts(df, f"{tmp_path}/m", "scope")


def test_tables_inside_tables_and_spans_to_the_end():
    from corvane.sources.files import table_grid

    html = "<table><tr><td rowspan=0>a<td>b<table><tr><td>in</td></tr></table>tail</td></tr><tr><td colspan=2>c</td></tr></table>"
    got = table_grid(html)
    assert [g for g in got if g[0] == 0] == [(0, 0, 0, "a", 0, False), (0, 0, 1, "btail", 1, False), (0, 1, 0, "", 0, True), (0, 1, 1, "c", 3, False), (0, 1, 2, "", 3, True)]
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, "in", 2, False)]
    assert len(table_grid("<table><tr><td rowspan=99999999 colspan=5>x</td></tr></table>")) == 5 and table_grid("<td>none</td>") == table_grid(None) == []
