"""Spark data sources for the files of a document corpus; ``register(spark)`` makes them known to ``spark.read.format``.

* ``corvane_xlsx``: the filled cells of all sheets of workbooks: path, sheet, row, col, text;
* ``corvane_rtf``: the text of RTF files: path, text;
* ``corvane_manifest``: the records of a corpus that a manifest describes (JSON: a list of entries with doc_type, sources, exclude,
  status), read with the schema that the reader is given; ``doc_type`` comes from the entry.

Each file is one partition; files are listed when the query is planned and read in tasks, by pyarrow's file systems. Equality
filters on ``path`` (and ``doc_type``) leave out files, and one on ``sheet`` leaves out sheets, before anything is read.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.sources.files import rtf_text

_MAIN, _REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class FilePartition(InputPartition):
    def __init__(self, path: str, doc_type: str | None = None):
        super().__init__(path)
        self.path, self.doc_type = path, doc_type


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str) -> list[str]:
    """The files that a path, a folder or a pattern names, in order."""
    system, plain = _system(path)
    fixed = re.split(r"[*?\[]", plain)[0]
    if fixed != plain:
        folder = fixed.rpartition("/")[0]
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.path, plain))
    info = system.get_file_info(plain)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(plain, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
    return [plain] if info.is_file else []


def read_bytes(path: str) -> bytes:
    system, plain = _system(path)
    with system.open_input_stream(plain) as f:
        return f.read()


def sheets(content: bytes, wanted: str | None = None) -> Iterator[tuple[str, int, str, str]]:
    """Sheet, row number, column letters and text of the filled cells of a workbook."""
    with zipfile.ZipFile(pa.BufferReader(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)]
            name = sheet.get("name", "")
            if wanted is not None and name != wanted:
                continue
            for cell in ElementTree.fromstring(z.read(target[1:] if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}c"):
                place, value = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", "")), cell.find(f"{_MAIN}v")
                inline = cell.find(f"{_MAIN}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else value.text if value is not None else None
                if place and text is not None:
                    yield name, int(place[2]), place[1], shared[int(text)] if cell.get("t") == "s" else text


class FilesReader(DataSourceReader):
    """One partition for each file; equality filters on the columns in ``by`` are held here."""

    by: tuple[str, ...] = ("path",)

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.only = schema, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.by:
                self.only.setdefault(f.attribute[0], set()).add(f.value)
            yield f  # Spark checks the rows again

    def fits(self, **values: str) -> bool:
        return all(self.only.get(k, {v}) == {v} for k, v in values.items())

    def files(self) -> list[FilePartition]:
        path = self.options.get("path", "")
        found = listed(path)
        if not found:
            raise ValueError(f"no files in {path}")
        return [FilePartition(p) for p in found]

    def partitions(self) -> list[FilePartition]:
        return [p for p in self.files() if self.fits(path=p.path)]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is not None:  # else there are no partitions
            yield from self.rows(partition)


class XlsxReader(FilesReader):
    by = ("path", "sheet")

    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        wanted = self.only.get("sheet")
        if wanted is None or len(wanted) == 1:
            for cell in sheets(read_bytes(partition.path), None if wanted is None else next(iter(wanted))):
                yield (partition.path, *cell)


class RtfReader(FilesReader):
    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        yield partition.path, rtf_text(read_bytes(partition.path))


class ManifestReader(FilesReader):
    by = ("doc_type",)

    def files(self) -> list[FilePartition]:
        """The files of all active entries. A doc_type that occurs twice and a source without a file are errors."""
        base = self.options.get("base", "").rstrip("/")
        entries = [e for e in json.loads(read_bytes(self.options["path"])) if e.get("status") == "active"]
        kinds = [e["doc_type"] for e in entries]
        if twice := sorted({k for k in kinds if kinds.count(k) > 1}):
            raise ValueError(f"doc_type occurs twice: {twice}")
        out = []
        for e in entries:
            own: list[str] = []
            for source in e.get("sources") or []:
                found = listed(f"{base}/{source}")
                if not found:
                    raise ValueError(f"{e['doc_type']}: no file for {source}")
                own += [p for p in found if p not in own]
            skip = e.get("exclude") or []
            out += [FilePartition(p, e["doc_type"]) for p in own if not any(fnmatch.fnmatch(p.rpartition("/")[2], x) for x in skip)]
        return out

    def partitions(self) -> list[FilePartition]:
        return [p for p in self.files() if self.fits(doc_type=p.doc_type)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            records = json.loads(read_bytes(partition.path))
            rows = [{k: partition.doc_type if k == "doc_type" else r.get(k) for k in self.schema.names} for r in records]
            yield from pa.Table.from_pylist(rows, schema=to_arrow_schema(self.schema)).to_batches()


class _Files(DataSource):
    Reader = FilesReader
    columns = ""

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.Reader(schema, dict(self.options))


class Xlsx(_Files):
    Reader, columns = XlsxReader, "path string, sheet string, row int, col string, text string"

    @classmethod
    def name(cls) -> str:
        return "corvane_xlsx"


class Rtf(_Files):
    Reader, columns = RtfReader, "path string, text string"

    @classmethod
    def name(cls) -> str:
        return "corvane_rtf"


class Manifest(_Files):
    Reader = ManifestReader

    @classmethod
    def name(cls) -> str:
        return "corvane_manifest"

    def schema(self) -> str:
        raise ValueError("corvane_manifest is read with a schema")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Xlsx, Rtf, Manifest):
        spark.dataSource.register(source)
