"""Integrity queries: differences between tables and editions, rows and clauses of texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import diff
from corvane.operators import integrity as I
from corvane.operators import parsers
from corvane.sources import store
from corvane.sources.tables import table


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that even and odd orders hold differently often."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return I.multiset_difference(lines.where("l_orderkey % 2 = 0").select("l_partkey"), lines.where("l_orderkey % 2 = 1").select("l_partkey"))


MULTISET_SQL = "SELECT l_partkey, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d)::BIGINT AS times FROM (SELECT l_partkey, sum(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS d FROM lineitem GROUP BY 1) WHERE d <> 0"


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part pairs of cheap lines that stay when those of discounted lines are taken away one by one."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_quantity < 25").select("l_returnflag", "l_suppkey").exceptAll(lines.where("l_discount > 0.05").select("l_returnflag", "l_suppkey"))


EXCEPT_SQL = "SELECT l_returnflag, l_suppkey FROM lineitem WHERE l_quantity < 25 EXCEPT ALL SELECT l_returnflag, l_suppkey FROM lineitem WHERE l_discount > 0.05"


def set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a document has added to or removed from those of the one before it in its source."""
    from corvane.functions.text import tokens

    docs = table(spark, sf_dir, "documents")
    # ids alone are put in order; words are fetched for pairs
    pairs = docs.select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("before_id")).where("before_id IS NOT NULL")
    words = docs.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    rows = pairs.join(words, "doc_id").join(words.toDF("before_id", "before"), "before_id")
    return rows.select("doc_id", F.size(F.array_except("w", "before")).cast("bigint").alias("added"), F.size(F.array_except("before", "w")).cast("bigint").alias("removed"), F.size(F.array_intersect("w", "before")).cast("bigint").alias("common"))


CHANGES_SQL = r"""WITH w AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), lambda x: length(x) > 1)) AS w FROM documents), b AS (SELECT *, lag(w) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM w)
SELECT doc_id, len(list_filter(w, lambda x: NOT list_contains(before, x))) AS added, len(list_filter(before, lambda x: NOT list_contains(w, x))) AS removed, len(list_intersect(w, before)) AS common FROM b WHERE before IS NOT NULL"""


def payload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two editions of the parts: prices of some, types of others, some gone, some new."""
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 17 <> 0").select("p_partkey", "p_type", "p_retailprice")
    new = part.where("p_partkey % 19 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "NEW").otherwise(F.col("p_type")).alias("p_type"), F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    return I.changed_rows(old, new, "p_partkey", ["p_type", "p_retailprice"])


PAYLOAD_SQL = """WITH o AS (SELECT p_partkey, p_type AS t, p_retailprice AS p FROM part WHERE p_partkey % 17 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NEW' ELSE p_type END AS t, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p FROM part WHERE p_partkey % 19 <> 0),
j AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.t IS DISTINCT FROM n.t OR o.p IS DISTINCT FROM n.p THEN 'changed' END AS status, concat_ws(',', CASE WHEN o.t IS DISTINCT FROM n.t THEN 'p_type' END, CASE WHEN o.p IS DISTINCT FROM n.p THEN 'p_retailprice' END) AS c FROM o FULL JOIN n USING (p_partkey))
SELECT p_partkey, status, CASE WHEN status = 'changed' THEN c END AS columns FROM j WHERE status IS NOT NULL"""


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th order of a customer beside the i-th urgent one, and whether both lists have the same length."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return I.zipped(orders.select("o_custkey", "o_orderkey"), orders.where("o_orderpriority < '3'").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


ZIP_SQL = """WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderpriority < '3' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT coalesce(l.o_custkey, r.o_custkey) AS o_custkey, coalesce(l.place, r.place)::INTEGER AS place, l.o_orderkey, r.o_orderkey AS o_orderkey_right, l.n IS NOT DISTINCT FROM r.n AS whole FROM l FULL JOIN r ON l.o_custkey = r.o_custkey AND l.place = r.place"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows


LINES = "lines AS (SELECT doc_id, unnest(range(0, len(l)))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def logical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines joined to logical rows; every third line is made to end with a bar, every seventh to start with a code."""
    line = F.concat(F.when(F.col("line_no") % 7 == 5, "1.2 ").otherwise(""), F.col("line"), F.when(F.col("line_no") % 3 == 2, " |").otherwise(""))
    return I.logical_rows(_lines(spark, sf_dir).withColumn("line", line), "doc_id", "line_no", "line")


LOGICAL_SQL = rf"""WITH {LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 5 THEN '1.2 ' ELSE '' END || line || CASE WHEN line_no % 3 = 2 THEN ' |' ELSE '' END AS line FROM lines),
s AS (SELECT *, regexp_matches(line, '^\s*\d+(\.\d+)+') OR coalesce(lag(regexp_matches(line, '\|\s*$')) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS s FROM m),
r AS (SELECT *, sum(s::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM s)
SELECT doc_id, row_no::BIGINT AS row_no, count(*) AS n_lines, string_agg(trim(line, ' '), ' ' ORDER BY line_no) AS row_text FROM r GROUP BY doc_id, row_no"""


def filled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document under the last short line before them; lines are counted by header."""
    rows = _lines(spark, sf_dir).withColumn("header", F.when(F.length("line") < 25, F.col("line")))
    return I.filled_forward(rows, "doc_id", "line_no", "header").groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("n"))


FILLED_SQL = f"WITH {LINES}, f AS (SELECT doc_id, last_value(CASE WHEN length(line) < 25 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM lines) SELECT doc_id, header, count(*) AS n FROM f GROUP BY 1, 2"


def clause_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered clauses of documents whose every fourth line got a number."""
    line = F.when(F.col("line_no") % 4 == 1, F.concat((F.col("line_no") / 4).cast("int") + 1, F.lit(". "), "line")).otherwise(F.col("line"))
    rows = I.clauses(_lines(spark, sf_dir).withColumn("line", line), "doc_id", "line_no", "line")
    return rows.select("doc_id", "clause_no", "point", F.length("clause").cast("bigint").alias("n_chars"), F.sha1("clause").alias("digest"))


CLAUSE_SQL = rf"""WITH {LINES}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN (line_no // 4 + 1) || '. ' || line ELSE line END AS line FROM lines),
p AS (SELECT *, CASE WHEN regexp_matches(line, '^(\d+(?:\.\d+)*)[.)]\s+') THEN regexp_extract(line, '^(\d+(?:\.\d+)*)[.)]\s+', 1) END AS p FROM m), c AS (SELECT *, sum((p IS NOT NULL)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS clause_no FROM p),
g AS (SELECT doc_id, clause_no::BIGINT AS clause_no, coalesce(max(p), '0') AS point, string_agg(line, chr(10) ORDER BY line_no) AS t FROM c GROUP BY 1, 2)
SELECT doc_id, clause_no, point, length(t) AS n_chars, sha1(t) AS digest FROM g"""


def edition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that two editions (documents 0 and 1 modulo 2) of each source hold differently often, counted by source."""
    rows = _lines(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("line <> ''")
    sides = I.multiset_difference(rows.where("doc_id % 2 = 0").select("source", "line"), rows.where("doc_id % 2 = 1").select("source", "line"))
    return sides.groupBy("source").agg(F.sum(F.when(F.col("side") == "left", F.col("times")).otherwise(0)).alias("removed"), F.sum(F.when(F.col("side") == "right", F.col("times")).otherwise(0)).alias("added"))


EDITION_SQL = f"WITH {LINES}, d AS (SELECT source, line, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS d FROM lines JOIN documents USING (doc_id) WHERE line <> '' GROUP BY 1, 2 HAVING sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) <> 0) SELECT source, sum(greatest(d, 0))::BIGINT AS removed, sum(greatest(-d, 0))::BIGINT AS added FROM d GROUP BY source"


def _page_editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of even and odd ids as two editions of one text, cut before each tag."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.expr("page_id div 2").alias("pair"), (F.col("page_id") % 2).alias("side"), F.posexplode(F.split("html", "(?=<)")).alias("place", "line"))
    return pages.where("side = 0").drop("side"), pages.where("side = 1").drop("side")


def line_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ranges of two editions are equal, replaced, deleted and inserted (no SQL: an alignment is chosen)."""
    return diff.opcodes(*_page_editions(spark, sf_dir))


def patched_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new edition made from the old one and the patch: digest and length; and the lines that the opcodes cover."""
    old, new = _page_editions(spark, sf_dir)
    ops = store.stored(diff.opcodes(old, new), "opcodes")
    made = diff.applied(old, diff.patch(ops, new)).select("pair", F.array_join("lines", "").alias("html"))
    covered = ops.groupBy("pair").agg(F.sum(F.col("old_to") - F.col("old_from")).alias("n_old"), F.sum(F.col("new_to") - F.col("new_from")).alias("n_new"))
    return made.join(covered, "pair").select("pair", F.sha1("html").alias("digest"), F.length("html").cast("bigint").alias("n_chars"), "n_old", "n_new")


PATCHED_SQL = """WITH p AS (SELECT page_id // 2 AS pair, page_id % 2 AS side, html, len(regexp_split_to_array(regexp_replace(html, '^<', ''), '<')) AS n FROM pages WHERE html IS NOT NULL)
SELECT pair, sha1(coalesce(b.html, '')) AS digest, length(coalesce(b.html, '')) AS n_chars, coalesce(a.n, 0)::BIGINT AS n_old, coalesce(b.n, 0)::BIGINT AS n_new
FROM (SELECT * FROM p WHERE side = 0) a FULL JOIN (SELECT * FROM p WHERE side = 1) b USING (pair)"""


def section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and added pieces of two editions by the new edition's sections (no SQL, as for ``line_opcodes``)."""
    old, new = _page_editions(spark, sf_dir)
    name = F.regexp_extract("line", "^<(nav|article|aside|footer|header|form|section|main|h[1-6])[ >]", 1)
    return diff.by_section(diff.opcodes(old, new), new, F.when(name != "", name))


def near_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which one begins with another in the same nation (customers' last digits make the names)."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.regexp_replace("c_name", "^Customer#0*", "no ").alias("name"))
    return I.near_prefixes(rows, "c_nationkey", "name", 4)


PREFIX_SQL = "WITH n AS (SELECT DISTINCT c_nationkey, regexp_replace(c_name, '^Customer#0*', 'no ') AS name FROM customer) SELECT a.c_nationkey, a.name AS shorter, b.name AS longer FROM n a JOIN n b ON a.c_nationkey = b.c_nationkey AND a.name <> b.name AND starts_with(b.name, a.name) WHERE length(a.name) >= 4"


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents share: how many, and the first."""
    rows = _lines(spark, sf_dir).where("length(line) > 20").groupBy(F.sha1("line").alias("digest")).agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return rows.where("n_docs > 1")


BLOCKS_SQL = f"WITH {LINES} SELECT sha1(line) AS digest, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM lines WHERE length(line) > 20 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"


def union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a window and of extras, of equal keys the window's first."""
    part = table(spark, sf_dir, "part")
    one = part.where("p_size < 20").select("p_name", "p_partkey", F.lit(1).alias("origin"))
    two = part.where("p_size > 10").select("p_name", "p_partkey", F.lit(2).alias("origin"))
    w = Window.partitionBy("p_name").orderBy("origin", "p_partkey")
    return one.union(two).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("p_name", "p_partkey", "origin")


UNION_SQL = "SELECT p_name, p_partkey, origin FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY origin, p_partkey) AS rn FROM (SELECT p_name, p_partkey, 1 AS origin FROM part WHERE p_size < 20 UNION ALL SELECT p_name, p_partkey, 2 FROM part WHERE p_size > 10)) WHERE rn = 1"


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index after two sources were indexed anew (every second of their rows left, lengths new)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("source IN ('src1', 'src2') AND doc_id % 40 < 20").withColumn("n_chars", F.col("n_chars") + 1)
    return I.upserted(docs, new, "doc_id", "source")


REFRESH_SQL = "SELECT doc_id, source, n_chars + CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END AS n_chars FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 40 < 20"


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of parts by content, and whether two rows share one."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.sha1(F.concat_ws("|", "p_name", "p_brand", "p_size")).alias("content_id"))
    return rows.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("content_id")) > 1)


IDS_SQL = "SELECT p_partkey, sha1(concat_ws('|', p_name, p_brand, p_size)) AS content_id, count(*) OVER (PARTITION BY p_name, p_brand, p_size) > 1 AS shared FROM part"


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the table that each page's menu makes: a head beside two rows, three links in the first, the rest below."""
    from corvane.sources.files import html_grids

    links = F.transform(F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), 1), lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>")))
    row = lambda start, n: F.array_join(F.slice(links, start, n), "")
    html = F.concat(F.lit("<table><tr><td rowspan=2>links</td>"), row(1, 3), F.lit("</tr><tr>"), row(4, 1000), F.lit("</tr></table>"))
    return html_grids(table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", html.alias("html")), "page_id", "html")


CELLS_SQL = """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS l FROM pages WHERE html IS NOT NULL),
c AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM l)
SELECT page_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, 'links' AS text, 0 AS cell_no, false AS covered FROM l UNION ALL SELECT page_id, 0, 1, 0, '', 0, true FROM l
UNION ALL SELECT page_id, 0, CASE WHEN i <= 3 THEN 0 ELSE 1 END, CASE WHEN i <= 3 THEN i ELSE i - 3 END, trim(regexp_replace(t, '\\s+', ' ', 'g')), i, false FROM c"""


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all documents (prose, or lines with bars) and pages by the parser of their kind."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.contains(F.col("text"), F.lit("|")), "bars").otherwise("prose").alias("doc_type"), "text")
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.concat(F.lit("p"), "page_id").alias("id"), F.lit("page").alias("doc_type"), F.col("html").alias("text"))
    return parsers.parsed(docs.union(pages), "doc_type", "text").select("id", "part_no", "point", "kind", F.sha1("part").alias("digest"))


PARSED_SQL = r"""WITH l AS (SELECT 'd' || doc_id AS id, contains(text, '|') AS bars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT id, n, contains(line, '|') AS is_row, CASE WHEN contains(line, '|') THEN array_to_string(list_transform(string_split(trim(trim(line), '|'), '|'), lambda c: trim(c)), chr(9)) ELSE trim(line) END AS part FROM l WHERE trim(line) <> ''),
h AS (SELECT 'p' || page_id AS id, unnest(list_concat(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), regexp_extract_all(html, '<h1>[^<]*</h1>'))) AS m, generate_subscripts(list_concat(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), regexp_extract_all(html, '<h1>[^<]*</h1>')), 1) AS n FROM pages WHERE html IS NOT NULL)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n))::INTEGER AS part_no, n::VARCHAR AS point, CASE WHEN is_row THEN 'row' ELSE 'line' END AS kind, sha1(part) AS digest FROM r
UNION ALL SELECT id, n::INTEGER, CASE WHEN m LIKE '<h1>%' THEN 'h1' ELSE regexp_extract(m, 'href="([^"]*)"', 1) END, CASE WHEN m LIKE '<h1>%' THEN 'heading' ELSE 'link' END, sha1(regexp_extract(m, '>([^<>]*)</', 1)) FROM h"""

QUERIES = {
    "parsed_documents": (parsed_documents, PARSED_SQL),
    "multiset_diff": (multiset_diff, MULTISET_SQL),
    "except_all": (except_all, EXCEPT_SQL),
    "set_changes": (set_changes, CHANGES_SQL),
    "payload_diff": (payload_diff, PAYLOAD_SQL),
    "positional_zip": (positional_zip, ZIP_SQL),
    "logical_rows": (logical_rows, LOGICAL_SQL),
    "filled_headers": (filled_headers, FILLED_SQL),
    "clause_parts": (clause_parts, CLAUSE_SQL),
    "edition_diff": (edition_diff, EDITION_SQL),
    "line_opcodes": (line_opcodes, None),
    "patched_editions": (patched_editions, PATCHED_SQL),
    "section_changes": (section_changes, None),
    "near_prefixes": (near_prefixes, PREFIX_SQL),
    "text_blocks": (text_blocks, BLOCKS_SQL),
    "union_first": (union_first, UNION_SQL),
    "refreshed": (refreshed, REFRESH_SQL),
    "content_ids": (content_ids, IDS_SQL),
    "html_cells": (html_cells, CELLS_SQL),
}
