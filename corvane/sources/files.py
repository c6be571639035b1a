"""Readers for the file formats of a document corpus: JSON records, lists by manifest, TSV, logs, XLSX, RTF, HTML tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Files that each hold an array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def manifest_records(spark: SparkSession, manifest: DataFrame, base: str, schema: str) -> DataFrame:
    """The records of all active entries of a manifest (doc_type, path, excluded, status), with their doc_type.

    The manifest is small by nature (a row for each source) and read on the driver. An active entry that names no file,
    or a doc_type that occurs twice, is an error.
    """
    entries = manifest.where("status = 'active'").collect()
    kinds = [e["doc_type"] for e in entries]
    if len(set(kinds)) < len(kinds):
        raise ValueError(f"doc_type occurs twice: {sorted(k for k in set(kinds) if kinds.count(k) > 1)}")
    out = None
    for e in entries:
        rows = json_records(spark, f"{base}/{e['path']}", schema).withColumn("doc_type", F.lit(e["doc_type"])).withColumn("_file", F.col("_metadata.file_name"))
        for pattern in e["excluded"] or []:
            rows = rows.where(~F.col("_file").like(pattern.replace("*", "%")))
        rows = rows.drop("_file")
        out = rows if out is None else out.unionByName(rows)
    if out is not None:
        found = {r["doc_type"] for r in out.select("doc_type").distinct().collect()}
        if missing := [e for e in entries if e["doc_type"] not in found]:
            raise ValueError(", ".join(f"{e['doc_type']}: no records in {e['path']}" for e in missing))
    return out


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; lines that don't fit the schema are dropped."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def parsed_log(lines: DataFrame, mark: str, schema: str) -> DataFrame:
    """JSON objects behind a mark in log lines (column value); lines without it and broken objects are dropped."""
    tail = F.expr(f"substring(value, instr(value, '{mark}') + {len(mark)})")
    rows = lines.where(F.contains(F.col("value"), F.lit(mark))).select(F.from_json(tail, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return rows.where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def log_events(spark: SparkSession, path: str, mark: str, schema: str) -> DataFrame:
    return parsed_log(spark.read.text(path), mark, schema)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet_rows(content: bytes) -> Iterator[tuple[int, str, str]]:
    """Row number, column letters and text of the filled cells of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for cell in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:c", _NS):
            place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
            value = cell.find("m:v", _NS)
            text = "".join(t.text or "" for t in cell.iterfind(".//m:is//m:t", _NS)) if cell.get("t") == "inlineStr" else value.text if value is not None else None
            if place and text is not None:
                yield int(place[2]), place[1], shared[int(text)] if cell.get("t") == "s" else text


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """Filled cells of the first sheet of each workbook: path, row, col, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *c) for p, content in zip(pdf["path"], pdf["content"], strict=True) for c in _sheet_rows(content)], columns=["path", "row", "col", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, col string, text string")


def rtf_text(content: bytes) -> str:
    """Text of an RTF file in code page 1251, one line for each paragraph, without empty ones."""
    text = content.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1251", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def rtf_files(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": pdf["content"].map(rtf_text)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


class _Tables(HTMLParser):
    """Cells of all tables with the rows and columns that they span; a table inside a cell is a table of its own."""

    #: Fixed values of HTML: the largest spans.
    MOST = {"rowspan": 65534, "colspan": 1000}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[int] = []  # of each table
        self.cells: list[dict] = []
        self.stack: list[list] = []  # of open tables: number and open cell

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.stack.append([len(self.rows), None])
            self.rows.append(0)
        elif self.stack and tag == "tr":
            self.rows[self.stack[-1][0]] += 1
            self.stack[-1][1] = None
        elif self.stack and tag in ("td", "th"):
            table = self.stack[-1][0]
            self.rows[table] = max(self.rows[table], 1)
            spans = {k: min(int(v), self.MOST[k]) if (v or "").isdigit() else 1 for k, v in attrs if k in self.MOST}
            cell = {"table": table, "row": self.rows[table] - 1, "text": "", "down": spans.get("rowspan", 1), "right": spans.get("colspan", 1) or 1}
            self.stack[-1][1] = cell
            self.cells.append(cell)

    def handle_endtag(self, tag: str) -> None:
        if self.stack and tag in ("td", "th", "tr"):
            self.stack[-1][1] = None
        elif self.stack and tag == "table":
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1] is not None:
            self.stack[-1][1]["text"] += data


def table_grid(html: str | None) -> list[tuple[int, int, int, str, int, bool]]:
    """Table, row, column, text, cell number and whether the place is covered by a span from elsewhere.

    A cell's text stands at its first place only; covered places have the number of the cell that covers them. A row span
    ends with its table; a span of zero rows goes to its end.
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    taken: dict[tuple[int, int, int], tuple[str, int, bool]] = {}
    for number, cell in enumerate(parser.cells):
        col = 0
        while (cell["table"], cell["row"], col) in taken:
            col += 1
        left = parser.rows[cell["table"]] - cell["row"]
        for down in range(min(cell["down"] or left, left)):
            for right in range(cell["right"]):
                first = not down and not right
                taken.setdefault((cell["table"], cell["row"] + down, col + right), (" ".join(cell["text"].split()) if first else "", number, not first))
    return [(*place, *found) for place, found in sorted(taken.items())]


def html_grids(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """The places of all tables of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *g) for i, h in zip(pdf["id"], pdf["html"], strict=True) for g in table_grid(h)], columns=["id", "table_no", "row_no", "col_no", "text", "cell_no", "covered"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "id bigint, table_no int, row_no int, col_no int, text string, cell_no int, covered boolean").withColumnRenamed("id", id_col)
