"""Writers: JSON, workbooks, CSV with semicolons, Markdown or plain texts of conversations, tables by scope."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, a header, and a byte order mark before it, as office programs like it."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_texts(df: DataFrame, path: str, text: str) -> None:
    """One line or text for each row."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def replace_scopes(df: DataFrame, path: str, scope: str) -> None:
    """Replace the folders of those scopes that ``df`` holds, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def workbook(cells: list[tuple[str, int, int, str]]) -> bytes:
    """A workbook of texts from cells (sheet, row and column from 1 on, text), sheets in the order of their names."""
    out = io.BytesIO()
    names = sorted({c[0] for c in cells})
    letters = lambda n: (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            rows: dict[int, list[str]] = {}
            for _, row, col, text in sorted(c for c in cells if c[0] == name):
                rows.setdefault(row, []).append(f'<c r="{letters(col)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(cells: DataFrame, path: str) -> int:
    """Write one workbook for each value of ``workbook`` from cells (workbook, sheet, row, col, text); returns how many. A workbook
    fits a task by nature (it has at most 2**20 rows a sheet)."""

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        system, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        system.create_dir(folder, recursive=True)
        texts = [tuple(r.values()) for r in rows.select(["sheet", "row", "col", "text"]).to_pylist() if r["text"] is not None]
        with system.open_output_stream(f"{folder}/{key[0].as_py()}.xlsx") as f:
            f.write(workbook(texts))
        return pa.table({"n": [1]})

    return cells.groupBy("workbook").applyInArrow(put, "n bigint").count()
