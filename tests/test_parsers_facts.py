"""Parsers by kind and their contract; facts of blocks beside a plain reader; strict and loose attribution."""

import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import facts
from corvane.operators import parsers

CLAUSES = "intro\n1. First\nmore\n\n1.1) Second\n  2. Third"
NOTES = "text\n<1> one\nstill one\n<9(1)> nine"
TALK = "hello\nWhy?\nBecause.\nSo.\nAnd?\nYes"


def test_parsers_of_all_kinds(spark):
    parsers.register(spark)
    docs = spark.createDataFrame([(1, "clauses", CLAUSES), (2, "footnotes", NOTES), (3, "questions", TALK), (4, "prose", "a\n\n b "), (5, "bars", "x | y |\nz"), (6, "page", '<h1>T</h1><ul><li><a href="/u">V</a></li></ul>'), (7, "prose", None), (8, "clauses", "")], "id bigint, doc_type string, text string")
    got = {}
    for r in parsers.parsed(docs, "doc_type", "text").collect():
        got.setdefault(r.id, []).append((r.part_no, r.point, r.kind, r.part))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, "0", "preamble", "intro"), (2, "1", "clause", "First\nmore"), (3, "1.1", "clause", "Second"), (4, "2", "clause", "Third")],
        2: [(1, "1", "footnote", "one\nstill one"), (2, "9(1)", "footnote", "nine")],
        3: [(1, "1", "question", "Why?"), (2, "1", "answer", "Because.\nSo."), (3, "2", "question", "And?"), (4, "2", "answer", "Yes")],
        4: [(1, "1", "line", "a"), (2, "3", "line", "b")], 5: [(1, "1", "row", "x\ty"), (2, "2", "line", "z")], 6: [(1, "h1", "heading", "T"), (2, "/u", "link", "V")],
    }
    docs.createOrReplaceTempView("_docs")
    assert spark.sql("SELECT count(*) FROM _docs d, LATERAL parse_document(d.doc_type, d.text) p").first()[0] == sum(map(len, got.values()))
    spark.catalog.dropTempView("_docs")


def test_kinds_without_a_parser(spark):
    docs = spark.createDataFrame([("prose", "a"), ("poem", "b")], "doc_type string, text string")
    assert parsers.missing(docs, "doc_type") == ["poem"]
    with pytest.raises(Exception, match="no parser for poem"):
        parsers.parsed(docs, "doc_type", "text").collect()
    with pytest.raises(ValueError, match="prose has a parser"):
        parsers.parser("prose")(lambda text: iter(()))


@pytest.mark.parametrize("name", sorted(parsers.PARSERS))
@pytest.mark.parametrize("text", ["", "\n\n", "a", CLAUSES, NOTES, TALK, "x | y", "?" * 3, "1." * 50])
def test_contract(name, text):
    for part in parsers.PARSERS[name](text):
        assert len(part) == 3 and all(isinstance(x, str) for x in part) and part[1] and part[2] == part[2].strip()


BLOCKS = ["Other item\nThreshold: 5 points", "Target item of a long name\n  Threshold: 70 % from 2024 \nExcept: ships - 50\nweld - 12 points\npaint - 3,5 points\nweld again - 12 points\ncut - 100 points\nLIST NOT COMPLETE", "tail"]


def plain_facts(block):
    line = lambda p: (re.search(p, block, re.M) or [None, ""])[1].strip()
    points = set(re.findall(r"- (\d+(?:[.,]\d+)?) points", block))
    return line(r"^\s*Threshold:\s*(.+)$"), line(r"^Except:\s*(.+)$"), sorted(points, key=lambda x: -float(x.replace(",", "."))), "NOT COMPLETE" in block, "GROUP" in block


def test_facts(spark):
    rows = [(1, "\n\n".join(BLOCKS), "Target item of a long name and on"), (2, "\n\n".join(BLOCKS), "Nowhere"), (3, "\n\n".join(BLOCKS), None), (4, "", "x"), (5, "no facts", "")]
    df = spark.createDataFrame(rows, "id int, text string, target string")
    block = facts.target_block(F.col("text"), F.col("target"))
    found = facts.facts(F.col("block"), r"^\s*Threshold:\s*(.+)$", r"^Except:\s*(.+)$", r"- (\d+(?:[.,]\d+)?) points", {"incomplete": "NOT COMPLETE", "inherited": "GROUP"})
    got = {r.id: (r.block, tuple(r.f)) for r in df.withColumn("target", F.substring("target", 1, 26)).withColumn("block", block).withColumn("f", found).collect()}
    want = {1: BLOCKS[1], 2: BLOCKS[0], 3: BLOCKS[0], 4: "", 5: "no facts"}
    assert got == {k: (b, plain_facts(b)) for k, b in want.items()}
    assert got[1][1][2] == ["100", "12", "3,5"]


def test_attribution(spark):
    rows = [("see section IV here", "IV", "Ships", True), ("see SECTIONS IV, V", "IV", "", True), ("section IVa", "IV", "Ships", False), ("about musical  instruments and sound", "XXV", "Musical instruments <5>, <9(1)> (as amended by N 2146)", True), ("instruments only", "XXV", "Musical instruments", False), (None, "I", "x", False), ("text", None, None, False)]
    df = spark.createDataFrame(rows, "text string, number string, title string, want boolean")
    got = df.select("want", facts.attributed(F.col("text"), F.col("number"), F.col("title")).alias("strict"), facts.on_subject(F.col("text"), F.col("title")).alias("loose")).collect()
    assert [r.strict for r in got] == [r.want for r in got] and [r.loose for r in got] == [False, False, False, True, True, False, False]


def test_document_facts_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    from corvane.plans import evaluation
    from tests.compare import compare, oracle

    texts = ["id 123456789012345678901234567890 and 5, 6", "0.12345678901234567 9,12345678901 1.5 1,5 01.5", "1" * 400 + " 7 " + "9" * 308, "Licensed under MIT\r\nx a@b.c"]
    texts += ["a\rLicensed under X\u2028y", "\x0bLicensed under Q", "Licensed under \u2003X\u00a0\n", "\u0085me@x.y", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = evaluation.QUERIES["document_facts"]
    ok, said = compare(spark, oracle(str(tmp_path)), "document_facts", query, sql, str(tmp_path))
    assert ok, said
