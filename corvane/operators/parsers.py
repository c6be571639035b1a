"""Parsers of documents by kind: a registry of small generators behind one table function, joined laterally.

    parsed(docs, "doc_type", "text")      # or, in SQL after register(spark): docs d, LATERAL parse_document(d.doc_type, d.text)

A parser gets a text and yields (point, kind, text) for each part; ``parser(doc_type)`` puts it into the registry. A kind without
a parser is an error of the query, named before it runs by ``missing``. A null text has no parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Part = tuple[str, str, str]
PARSERS: dict[str, Callable[[str], Iterator[Part]]] = {}


def parser(doc_type: str) -> Callable:
    def put(f: Callable[[str], Iterator[Part]]) -> Callable[[str], Iterator[Part]]:
        if doc_type in PARSERS:
            raise ValueError(f"{doc_type} has a parser")
        PARSERS[doc_type] = f
        return f

    return put


def _marked(text: str, mark: re.Pattern, kind: str, before: str) -> Iterator[Part]:
    """Parts that start at lines with a mark (its first group is the point; the mark itself goes); lines before the first one are a
    part of their own."""
    point, name, lines = "0", before, []
    for line in text.split("\n"):
        if m := mark.match(line):
            if any(x.strip() for x in lines):
                yield point, name, "\n".join(lines).strip()
            point, name, lines = m[1], kind, [line[m.end() :]]
        else:
            lines.append(line)
    if any(x.strip() for x in lines):
        yield point, name, "\n".join(lines).strip()


@parser("clauses")
def clauses(text: str) -> Iterator[Part]:
    """Numbered clauses, with what stands before the first as a preamble."""
    yield from _marked(text, re.compile(r"\s*(\d+(?:\.\d+)*)[.)]\s+"), "clause", "preamble")


@parser("footnotes")
def footnotes(text: str) -> Iterator[Part]:
    """Footnotes behind their numbers in angle brackets; text before the first is no footnote."""
    yield from (p for p in _marked(text, re.compile(r"\s*<(\d+(?:\(\d+\))?)>\s*"), "footnote", "") if p[1])


@parser("questions")
def questions(text: str) -> Iterator[Part]:
    """A line that ends with a question mark, and the lines up to the next one as its answer."""
    n, answer = 0, []
    for line in [*text.split("\n"), "?"]:
        if line.rstrip().endswith("?"):
            if n and any(x.strip() for x in answer):
                yield str(n), "answer", "\n".join(answer).strip()
            if line != "?":
                n, answer = n + 1, []
                yield str(n), "question", line.strip()
        elif n:
            answer.append(line)


@parser("prose")
def prose(text: str) -> Iterator[Part]:
    """One part for each line that isn't blank; the point is the line's number."""
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            yield str(n), "line", line.strip()


@parser("bars")
def bars(text: str) -> Iterator[Part]:
    """Lines with bars as rows of cells (joined by tabs), other lines as text."""
    for n, line in enumerate(text.split("\n"), 1):
        if "|" in line:
            yield str(n), "row", "\t".join(c.strip() for c in line.strip().strip("|").split("|"))
        elif line.strip():
            yield str(n), "line", line.strip()


@parser("page")
def page(text: str) -> Iterator[Part]:
    """The heading and the menu's links of a web page; a link's point is where it leads."""
    for m in re.finditer(r'<h1>([^<]*)</h1>|<li><a href="([^"]*)">([^<]*)</a></li>', text):
        yield ("h1", "heading", m[1]) if m[1] is not None else (m[2], "link", m[3])


SCHEMA = "part_no int, point string, kind string, part string"


class ParseDocument:
    def eval(self, doc_type: str, text: str):  # noqa: ANN201
        if doc_type not in PARSERS:
            raise ValueError(f"no parser for {doc_type}")
        for n, (point, kind, part) in enumerate(PARSERS[doc_type](text) if text is not None else (), 1):
            yield n, point, kind, part


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_document", F.udtf(ParseDocument, returnType=SCHEMA))


def missing(docs: DataFrame, doc_type: str) -> list[str]:
    """The kinds of documents that have no parser (a row for each kind)."""
    return sorted({str(r[0]) for r in docs.select(doc_type).distinct().collect()} - set(PARSERS))


def parsed(docs: DataFrame, doc_type: str, text: str) -> DataFrame:
    """The rows of ``docs`` with part_no, point, kind and part of each of their parts."""
    parts = F.udtf(ParseDocument, returnType=SCHEMA)
    return docs.lateralJoin(parts(F.col(doc_type).outer(), F.col(text).outer()))
