"""Data sources: workbooks with several sheets, RTF, manifests; filters leave out files and sheets."""

import io
import json
import zipfile

import pytest

from corvane.sources import formats


def workbook(sheets, shared=False):
    """A workbook with the given sheets (name: rows of texts); null cells are left out."""
    out, strings = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/part{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = []
            for r, row in enumerate(rows, 1):
                for c, x in enumerate(row):
                    if x is None:
                        continue
                    place = f"{chr(65 + c)}{r}"
                    if shared:
                        strings.append(x)
                        cells.append(f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>')
                    else:
                        cells.append(f'<c r="{place}" t="inlineStr"><is><t>{x}</t></is></c>')
            z.writestr(f"xl/worksheets/part{i}.xml", f'<worksheet xmlns="{ns}"><sheetData><row>' + "".join(cells) + "</row></sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
    return out.getvalue()


@pytest.fixture(scope="module")
def spark_with(spark):
    formats.register(spark)
    return spark


def test_workbooks(spark_with, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"one": [["x", None, "z"], [None, "y"]], "two": [["t"]]}))
    (tmp_path / "b.xlsx").write_bytes(workbook({"two": [["shared", "words"]]}, shared=True))
    (tmp_path / "_skipped").write_bytes(b"no workbook")
    df = spark_with.read.format("corvane_xlsx").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    rows = sorted((r.path[-6], r.sheet, r.row, r.col, r.text) for r in df.collect())
    assert rows == [("a", "one", 1, "A", "x"), ("a", "one", 1, "C", "z"), ("a", "one", 2, "B", "y"), ("a", "two", 1, "A", "t"), ("b", "two", 1, "A", "shared"), ("b", "two", 1, "B", "words")]
    one = df.where(df.sheet == "one")
    assert {r.text for r in one.collect()} == {"x", "y", "z"}
    only = df.where(df.path == str(tmp_path / "b.xlsx"))
    assert only.rdd.getNumPartitions() == 1 and only.count() == 2
    assert df.where((df.sheet == "one") & (df.sheet == "two")).count() == 0
    assert spark_with.read.format("corvane_xlsx").load(f"{tmp_path}/a*.xlsx").count() == 4
    with pytest.raises(Exception, match="no files"):
        spark_with.read.format("corvane_xlsx").load(f"{tmp_path}/none*").count()


def test_rtf(spark_with, tmp_path):
    (tmp_path / "a.rtf").write_bytes(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\'cf\'f0\'e8\par second \u8212? line\par}")
    assert [r.text for r in spark_with.read.format("corvane_rtf").load(str(tmp_path)).collect()] == ["При\nsecond — line"]


def test_manifest(spark_with, tmp_path):
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows), encoding="utf-8")
    put("a1.json", [{"point": "1", "text": "é", "codes": ["x", "y"]}, {"point": "2"}])
    put("a2.json", [{"point": "3", "text": "t", "more": 1}])
    put("a_draft.json", [{"point": "draft"}])
    put("b.json", [{"point": "9", "n": 4}])
    entries = [{"doc_type": "a", "sources": ["a*.json", "a1.json"], "exclude": ["*_draft.json"], "status": "active"}, {"doc_type": "b", "sources": ["b.json"], "status": "active"}, {"doc_type": "c", "sources": ["nothing.json"], "status": "off"}]
    put("manifest.json", entries)
    read = lambda: spark_with.read.format("corvane_manifest").schema("doc_type string, point string, text string, codes array<string>, n int").option("base", str(tmp_path)).load(str(tmp_path / "manifest.json"))
    rows = sorted(tuple(r) for r in read().collect())
    assert rows == [("a", "1", "é", ["x", "y"], None), ("a", "2", None, None, None), ("a", "3", "t", None, None), ("b", "9", None, None, 4)]
    assert read().where("doc_type = 'b'").rdd.getNumPartitions() == 1 and read().rdd.getNumPartitions() == 3
    for bad, said in (({"doc_type": "b", "sources": ["b.json"], "status": "active"}, "occurs twice"), ({"doc_type": "d", "sources": ["none*.json"], "status": "active"}, "no file for")):
        put("manifest.json", [*entries, bad])
        with pytest.raises(Exception, match=said):
            read().count()
