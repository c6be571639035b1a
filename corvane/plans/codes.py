"""Queries over hierarchical codes that are derived from parts, with their SQL.

A part's code is its brand number, size and last digit, dotted, of a depth from one to three that its key gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import codes as C
from corvane.operators import retrieval as R
from corvane.operators import tree
from corvane.sources import store
from corvane.sources.tables import table

CODES = """codes AS (SELECT p_partkey, p_name, p_type, p_retailprice, CASE p_partkey % 3 WHEN 0 THEN b WHEN 1 THEN b || '.' || s ELSE b || '.' || s || '.' || (p_partkey % 10) END AS code
 FROM (SELECT *, lpad(substr(p_brand, 7), 2, '0') AS b, lpad(p_size::VARCHAR, 2, '0') AS s FROM part))"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, size = F.lpad(F.substring("p_brand", 7, 9), 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    depth = F.col("p_partkey") % 3
    code = F.when(depth == 0, brand).when(depth == 1, F.concat_ws(".", brand, size)).otherwise(F.concat_ws(".", brand, size, F.col("p_partkey") % 10))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice", code.alias("code"))


def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits, key and dotted prefixes of every code; codes of three segments get a fourth with zeros at its end."""
    code = F.when(F.col("p_partkey") % 3 == 2, F.concat("code", F.lit(".1"), F.lit("00"))).otherwise(F.col("code"))
    rows = _codes(spark, sf_dir).withColumn("code", code)
    return rows.select("p_partkey", "code", C.digits(F.col("code")).alias("digits"), C.key(F.col("code")).alias("code_key"), F.array_join(C.prefixes(F.col("code")), "|").alias("prefixes"))


FORMS_SQL = f"""WITH {CODES}, c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN code || '.100' ELSE code END AS code FROM codes), s AS (SELECT *, string_split(code, '.') AS p FROM c)
SELECT p_partkey, code, regexp_replace(code, '[^0-9]', '', 'g') AS digits, CASE WHEN len(p) >= 4 THEN p[1] || p[2] || p[3] || CASE WHEN length(p[4]) = 3 THEN rtrim(p[4], '0') ELSE p[4] END ELSE regexp_replace(code, '[^0-9]', '', 'g') END AS code_key,
 array_to_string(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '.')), '|') AS prefixes FROM s"""


def code_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a queried code and a catalogue code of which one lies below the other (or both are the same)."""
    rows = _codes(spark, sf_dir).select("code").distinct().withColumn("k", C.digits(F.col("code")))
    asked = _codes(spark, sf_dir).where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), C.digits(F.col("code")).alias("q"))
    return C.related(asked, rows, "q", "k").select("query_id", "code", "relation")


HIERARCHY_SQL = f"""WITH {CODES}, k AS (SELECT DISTINCT code, replace(code, '.', '') AS k FROM codes), q AS (SELECT p_partkey AS query_id, replace(code, '.', '') AS q FROM codes WHERE p_partkey % 20 = 0)
SELECT query_id, code, length(k) - length(q) AS relation FROM q JOIN k ON starts_with(k, q) OR starts_with(q, k)"""


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-boosted search: matches by code in tiers before matches by price alone, in a total order, ten a query.

    Tiers are a matter of codes, so codes are compared, not parts. Of the parts of a code, of those below it and of those of a type, a
    query meets the nearest by price, and only in the tiers that those before them don't fill.
    """
    rows = _codes(spark, sf_dir).withColumn("k", C.digits(F.col("code")))
    asked = rows.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("k").alias("q"), F.col("p_retailprice").alias("want"), "p_type")
    parts = rows.select("p_partkey", "code", "k", "p_retailprice", "p_type")
    pairs = R.code_tiers(C.related(asked.select(F.col("q").alias("query_id")).distinct(), rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "query_id", "k")).withColumnRenamed("query_id", "q")
    sizes = pairs.groupBy("q", "tier").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("q").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1))
    open_tiers = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where("before < 10").select("q", "tier")
    pairs = store.stored(pairs.join(open_tiers, ["q", "tier"]).select("q", "k", "tier"), "codes")
    full = sizes.where("tier < 3").groupBy("q").agg(F.sum("n").alias("n")).where("n >= 10").select("q")
    # classes: the parts of a code (c), those below it (b), those of a type (t)
    cls = lambda kind, name: F.concat(F.lit(kind), F.col(name))
    held = parts.join(pairs.where("tier <> 1").select("k").distinct(), "k", "left_semi").withColumn("cls", cls("c", "k"))
    held = held.unionByName(parts.join(pairs.where("tier = 1").select("q", "k"), "k").withColumn("cls", cls("b", "q")).drop("q"))
    to_ask = pairs.select("q", "tier", F.when(F.col("tier") == 1, cls("b", "q")).otherwise(cls("c", "k")).alias("cls")).distinct()
    hits = R.nearest_values(asked.drop("p_type").join(to_ask, "q"), held.drop("p_type"), 10, "p_retailprice", ["code", "p_partkey"])
    # nine parts at most of the nearest of a type are in the tiers before, and those above the code by some levels are hits as such
    lacking = asked.join(full, "q", "left_anti").where("want IS NOT NULL").select("query_id", "q", "want", F.lit(3).alias("tier"), cls("t", "p_type").alias("cls"))
    # of the types (names of few), only those that such a query asks for are put in order
    of_type = parts.where("p_retailprice IS NOT NULL").withColumn("cls", cls("t", "p_type")).drop("p_type").join(F.broadcast(lacking.select("cls").distinct()), "cls", "left_semi")
    by_type = R.nearest_values(lacking, of_type, 20, "p_retailprice", ["code", "p_partkey"])
    by_type = by_type.where("abs(p_retailprice - want) <= 2 AND NOT (startswith(k, q) OR startswith(q, k))")
    hits = hits.unionByName(by_type).withColumn("gap", F.round(F.abs(F.col("p_retailprice") - F.col("want")), 4))
    return R.top_k(hits, "query_id", [F.asc("tier"), F.asc_nulls_last("gap"), F.asc("code"), F.asc("p_partkey")], 10).select("query_id", "p_partkey", "code", F.col("tier").cast("bigint").alias("tier"), "gap", "rank")


CODE_SEARCH_SQL = f"""WITH {CODES}, k AS (SELECT *, replace(code, '.', '') AS k FROM codes), q AS (SELECT p_partkey AS query_id, k AS q, p_retailprice AS want, p_type FROM k WHERE p_partkey % 20 = 0),
h AS (SELECT query_id, p_partkey, code, round(abs(p_retailprice - want), 4) AS gap, CASE WHEN starts_with(k, q) OR starts_with(q, k) THEN length(k) - length(q) END AS relation FROM q JOIN k ON starts_with(k, q) OR starts_with(q, k) OR (q.p_type = k.p_type AND abs(p_retailprice - want) <= 2)),
t AS (SELECT *, CASE WHEN relation = 0 THEN 0 WHEN relation > 0 THEN 1 WHEN relation < 0 AND NOT bool_or(coalesce(relation > 0, false)) OVER w AND relation = max(CASE WHEN relation < 0 THEN relation END) OVER w THEN 2 ELSE 3 END::BIGINT AS tier FROM h WINDOW w AS (PARTITION BY query_id))
SELECT query_id, p_partkey, code, tier, gap, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, gap, code, p_partkey) AS rank FROM t) WHERE rank <= 10"""


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each code, or of its deepest ancestor that has one; only codes of even parts have names."""
    rows = _codes(spark, sf_dir)
    known = rows.where("p_partkey % 2 = 0").groupBy("code").agg(F.min("p_name").alias("p_name"))
    return C.nearest_ancestor(rows.select("code").distinct(), known, "code", "p_name")


ANCESTOR_SQL = f"""WITH {CODES}, known AS (SELECT code AS k, min(p_name) AS n FROM codes WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT code, arg_max(k, length(k)) AS found_code, arg_max(n, length(k)) AS found_name FROM (SELECT DISTINCT code FROM codes) LEFT JOIN known ON code = k OR starts_with(code, k || '.') GROUP BY code"""


def code_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes translated by pairs (brand and size to type), by the exact code or its first five characters."""
    rows = _codes(spark, sf_dir)
    pairs = rows.where("p_partkey % 3 = 1 AND p_partkey % 4 < 2").select(F.col("code").alias("source"), F.col("p_type").alias("target")).distinct()
    return C.crosswalk(rows.select("code").distinct(), pairs, "code", 5)


CROSSWALK_SQL = f"""WITH {CODES}, pairs AS (SELECT DISTINCT code AS source, p_type AS target FROM codes WHERE p_partkey % 3 = 1 AND p_partkey % 4 < 2), c AS (SELECT DISTINCT code FROM codes),
e AS (SELECT code, target FROM c JOIN pairs ON code = source), r AS (SELECT code FROM c WHERE code NOT IN (SELECT source FROM pairs))
SELECT code, target, 'exact' AS way FROM e UNION ALL SELECT code, target, CASE WHEN target IS NULL THEN 'none' ELSE 'short' END FROM r LEFT JOIN pairs ON substr(code, 1, 5) = source AND length(code) > 5"""


def code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each code lies to a few ranges of codes; of several ranges with equal bounds each counts."""
    rules = spark.createDataFrame([(1, "02", "04"), (2, "0710", "0930"), (3, "11", None), (4, "171", "172"), (5, "2010", "2010")], "rule int, low string, high string")
    rows = _codes(spark, sf_dir).select("code").distinct().withColumn("k", C.digits(F.col("code")))
    # the rules are a short fixed list
    return rows.join(F.broadcast(rules)).select("code", "rule", C.in_range(F.col("k"), F.col("low"), F.col("high")).alias("match")).where("match <> 'none'")


RANGES_SQL = f"""WITH {CODES}, c AS (SELECT DISTINCT code, replace(code, '.', '') AS k FROM codes), r(rule, low, top) AS (VALUES (1, '02', '04'), (2, '0710', '0930'), (3, '11', '11'), (4, '171', '172'), (5, '2010', '2010')),
m AS (SELECT *, least(length(k), length(low)) AS a, least(length(k), length(top)) AS b FROM c, r)
SELECT code, rule, CASE WHEN (left(k, a) = left(low, a) AND length(k) < length(low)) OR (left(k, b) = left(top, b) AND length(k) < length(top)) THEN 'narrower' ELSE 'exact' END AS match FROM m WHERE left(k, a) >= left(low, a) AND left(k, b) <= left(top, b)"""


def excluded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules (brands) that fit a code, without those of which an exclusion covers it."""
    rows = _codes(spark, sf_dir).select("code").distinct().withColumn("k", C.digits(F.col("code")))
    rules = rows.where("length(code) = 2").select(F.col("k").alias("rule"))
    banned = rows.where("length(code) = 5 AND substring(code, 4, 2) < '10'").select(F.substring("k", 1, 2).alias("rule"), F.col("k").alias("ban"))
    fits = rows.withColumn("rule", F.explode(C.key_prefixes(F.col("k")))).join(rules, "rule")
    under = rows.withColumn("ban", F.explode(C.key_prefixes(F.col("k")))).join(banned, "ban").select("code", "rule").distinct()
    return fits.select("code", "rule").join(under, ["code", "rule"], "left_anti")


EXCLUDED_SQL = f"""WITH {CODES}, c AS (SELECT DISTINCT code, replace(code, '.', '') AS k FROM codes), r AS (SELECT k AS rule FROM c WHERE length(code) = 2), b AS (SELECT left(k, 2) AS rule, k AS ban FROM c WHERE length(code) = 5 AND substr(code, 4, 2) < '10')
SELECT code, rule FROM c JOIN r ON starts_with(k, rule) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rule = r.rule AND starts_with(k, ban))"""


def segment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on codes of one or two segments that hold for each code; segments are compared as wholes."""
    rows = _codes(spark, sf_dir).select("code").distinct()
    notes = rows.where("length(code) <= 5 AND code < '12'").select(F.col("code").alias("note"))
    return rows.withColumn("note", F.explode(C.prefixes(F.col("code")))).join(notes, "note").groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("note")), ",").alias("notes"))


NOTES_SQL = f"""WITH {CODES}, c AS (SELECT DISTINCT code FROM codes), n AS (SELECT code AS note FROM c WHERE length(code) <= 5 AND code < '12')
SELECT code, string_agg(note, ',' ORDER BY note) AS notes FROM c JOIN n ON code = note OR starts_with(code, note || '.') GROUP BY code"""


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes without a price of their own take the one of the code above them."""
    rows = _codes(spark, sf_dir).groupBy("code").agg(F.max(F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))).alias("price"))
    parent = F.when(F.contains(F.col("code"), F.lit(".")), F.regexp_replace("code", r"\.[^.]*$", ""))
    return C.inherited(rows.withColumn("parent", parent), "code", "parent", "price").select("code", "parent", "price", "inherited")


INHERIT_SQL = f"""WITH {CODES}, r AS (SELECT code, CASE WHEN contains(code, '.') THEN regexp_replace(code, '\\.[^.]*$', '') END AS parent, max(CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END) AS price FROM codes GROUP BY code)
SELECT r.code, r.parent, coalesce(r.price, p.price) AS price, r.price IS NULL AND p.price IS NOT NULL AS inherited FROM r LEFT JOIN r p ON p.code = r.parent"""


def tree_intros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all codes above each code, from the top, before its own (each code's least name)."""
    rows = _codes(spark, sf_dir).groupBy("code").agg(F.min("p_name").alias("name"))
    up = rows.withColumn("above", F.explode(C.prefixes(F.col("code")))).join(rows.toDF("above", "intro"), "above")
    per = up.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("above", "intro"))).alias("x"))
    return per.select("code", F.array_join(F.transform("x", lambda s: s["intro"]), " > ").alias("path"))


INTROS_SQL = f"""WITH {CODES}, r AS (SELECT code, min(p_name) AS name FROM codes GROUP BY code)
SELECT r.code, string_agg(a.name, ' > ' ORDER BY a.code) AS path FROM r JOIN r a ON r.code = a.code OR starts_with(r.code, a.code || '.') GROUP BY r.code"""


def capped_intros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the names (of 30 characters at most) of the codes above its own; a code of several parts ends the way up."""
    rows = tree.dotted_parents(_codes(spark, sf_dir).select("p_partkey", "code", "p_name"), "code")
    return tree.with_intros(rows, "p_partkey", "code", "parent", "p_name", 30, " > ").select("p_partkey", "code", "parent_intro", "index_text")


CAPPED_SQL = f"""WITH RECURSIVE {CODES}, n AS (SELECT code, count(*) AS n, min(p_name) AS name FROM codes GROUP BY code),
up AS (SELECT p_partkey, code AS here, 0 AS step, NULL::VARCHAR AS intro FROM codes
 UNION ALL SELECT p_partkey, regexp_replace(here, '\\.[^.]*$', ''), step + 1, CASE WHEN n.n = 1 AND length(name) <= 30 THEN name END FROM up LEFT JOIN n ON n.code = regexp_replace(here, '\\.[^.]*$', '') WHERE contains(here, '.') AND coalesce(n.n, 1) = 1)
SELECT c.p_partkey, c.code, arg_min(intro, step) FILTER (WHERE intro IS NOT NULL) AS parent_intro, coalesce(string_agg(intro, ' > ' ORDER BY step DESC) || ' > ', '') || any_value(p_name) AS index_text
FROM codes c JOIN up USING (p_partkey) GROUP BY ALL"""


def nearest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from each vector to its nearest other vector, on to that one's nearest, and so on, up to where it comes back."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    near = R.knn(vectors.withColumnRenamed("item_id", "query_id"), vectors, 2).where("item_id <> query_id")
    ways = tree.ways_up(near.groupBy("query_id").agg(F.min_by("item_id", "rank").alias("item_id")), "query_id", "item_id")
    return ways.select(F.col("key").alias("vec_id"), F.array_join(F.transform("way", lambda x: x.cast("string")), " ").alias("chain"), F.size("way").cast("bigint").alias("length"), "ended")


CHAINS_SQL = """WITH RECURSIVE pairs AS (SELECT q.vec_id AS a, d.vec_id AS b, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings d),
two AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM pairs),
near AS MATERIALIZED (SELECT a, arg_min(b, rank) AS b FROM two WHERE rank <= 2 AND a <> b GROUP BY a),
up AS (SELECT a AS vec_id, [a] AS way, false AS stop FROM near
 UNION ALL SELECT vec_id, CASE WHEN list_contains(way, b) THEN way ELSE list_append(way, b) END, list_contains(way, b) FROM up JOIN near ON near.a = way[-1] WHERE NOT stop)
SELECT vec_id, array_to_string(way, ' ') AS chain, len(way)::BIGINT AS length, 'cycle' AS ended FROM up WHERE stop"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly values (rounded mean price of urgent orders by nation), equal neighbouring years in one row."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").cast("bigint").alias("year")).agg((F.count(F.lit(1)) / 40).cast("int").cast("bigint").alias("value"))
    return C.collapsed_schedule(rows, ["c_nationkey"], "year", "value")


SCHEDULE_SQL = """WITH y AS (SELECT c_nationkey, year(o_orderdate) AS year, (count(*) // 40)::BIGINT AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN value = lag(value) OVER w AND year = lag(year) OVER w + 1 THEN 0 ELSE 1 END AS new FROM y WINDOW w AS (PARTITION BY c_nationkey ORDER BY year)),
r AS (SELECT *, sum(new) OVER (PARTITION BY c_nationkey ORDER BY year) AS run FROM n)
SELECT c_nationkey, value, min(year) AS first, max(year) AS last, CASE WHEN min(year) = max(year) THEN min(year)::VARCHAR ELSE min(year) || '-' || max(year) END AS label FROM r GROUP BY c_nationkey, run, value"""


def threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for each code by the first way that gives exactly one: name and type, the code, the code above, none."""
    rows = _codes(spark, sf_dir)
    asked = rows.select(F.col("p_partkey").alias("query_id"), "code", "p_name", "p_type")
    offers = rows.where("p_partkey % 7 < 2").select(F.col("code").alias("o_code"), F.col("p_name").alias("o_name"), F.col("p_type").alias("o_type"), "p_retailprice")
    # a way counts where it gives one offer alone, so offers are counted by what they are asked by before they meet the queries
    lone = lambda *by: offers.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("value")).where("n = 1")
    by_code = lone("o_code")
    one = lone("o_code", "o_name", "o_type").join(asked, (F.col("o_name") == F.col("p_name")) & (F.col("o_type") == F.col("p_type")) & (F.col("o_code") == F.col("code"))).select("query_id", F.lit(1).alias("way"), "value")
    two = by_code.join(asked, F.col("o_code") == F.col("code")).select("query_id", F.lit(2).alias("way"), "value")
    above = asked.withColumn("o_code", F.regexp_replace("code", r"\.[^.]*$", "")).where("o_code <> code")
    three = by_code.join(above, "o_code").select("query_id", F.lit(3).alias("way"), "value")
    found = one.union(two).union(three)
    best = found.groupBy("query_id").agg(F.min(F.struct("way", "value")).alias("b"))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("b.way", F.lit(0)).cast("bigint").alias("way"), "b.value")


THRESHOLD_SQL = f"""WITH {CODES}, q AS (SELECT * FROM codes), o AS (SELECT * FROM codes WHERE p_partkey % 7 < 2),
f AS (SELECT q.p_partkey AS query_id, 1 AS way, o.p_retailprice AS v FROM q JOIN o USING (code, p_name, p_type) UNION ALL SELECT q.p_partkey, 2, o.p_retailprice FROM q JOIN o USING (code)
 UNION ALL SELECT q.p_partkey, 3, o.p_retailprice FROM q JOIN o ON o.code = regexp_replace(q.code, '\\.[^.]*$', '') AND o.code <> q.code),
u AS (SELECT query_id, way, min(v) AS v FROM f GROUP BY 1, 2 HAVING count(*) = 1)
SELECT q.p_partkey AS query_id, coalesce(min(way), 0)::BIGINT AS way, arg_min(v, way) AS value FROM q LEFT JOIN u ON query_id = p_partkey GROUP BY 1"""


def target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hits of a search an answer is about: those of the best tier, or the first if none matches by code."""
    hits = code_search(spark, sf_dir)
    w = Window.partitionBy("query_id")
    best, any_match = F.min("tier").over(w), F.min("tier").over(w) < 3
    return hits.withColumn("target", F.when(any_match, F.col("tier") == best).otherwise(F.col("rank") == 1)).where("target").select("query_id", "p_partkey", "tier")


TARGET_SQL = f"SELECT query_id, p_partkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM ({CODE_SEARCH_SQL})) WHERE CASE WHEN best < 3 THEN tier = best ELSE rank = 1 END"


def found_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of known shape in free text, without dates; the text is made of part names and order dates."""
    rows = _codes(spark, sf_dir)
    text = F.concat(F.lit("item "), F.col("code"), F.lit(" of 12.05.2024 or "), F.regexp_replace("code", r"\.[^.]*$", ""), F.lit(".99.7 at 10:30"))
    known = rows.select(F.explode(C.prefixes(F.col("code"))).alias("hit")).distinct()
    hits = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)+)"), 1), lambda x: ~x.rlike(r"^\d{2}\.\d{2}\.\d{4}$")))
    return rows.where("p_partkey % 3 > 0").select("p_partkey", F.explode(hits).alias("hit")).join(known, "hit", "left_semi")


FOUND_SQL = f"""WITH {CODES}, p AS (SELECT DISTINCT array_to_string(string_split(code, '.')[1:i], '.') AS hit FROM codes, range(1, 4) t(i) WHERE i <= len(string_split(code, '.'))),
h AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all('item ' || code || ' of 12.05.2024 or ' || regexp_replace(code, '\\.[^.]*$', '') || '.99.7 at 10:30', '\\d+(?:\\.\\d+)+')) AS hit FROM codes WHERE p_partkey % 3 > 0)
SELECT p_partkey, hit FROM h WHERE NOT regexp_matches(hit, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') AND hit IN (SELECT hit FROM p)"""

QUERIES = {
    "code_forms": (code_forms, FORMS_SQL),
    "code_hierarchy": (code_hierarchy, HIERARCHY_SQL),
    "code_search": (code_search, CODE_SEARCH_SQL),
    "nearest_ancestor": (nearest_ancestor, ANCESTOR_SQL),
    "code_crosswalk": (code_crosswalk, CROSSWALK_SQL),
    "code_ranges": (code_ranges, RANGES_SQL),
    "excluded_codes": (excluded_codes, EXCLUDED_SQL),
    "segment_notes": (segment_notes, NOTES_SQL),
    "inheritance": (inheritance, INHERIT_SQL),
    "tree_intros": (tree_intros, INTROS_SQL),
    "capped_intros": (capped_intros, CAPPED_SQL),
    "nearest_chains": (nearest_chains, CHAINS_SQL),
    "schedules": (schedules, SCHEDULE_SQL),
    "threshold_lookup": (threshold_lookup, THRESHOLD_SQL),
    "target_selection": (target_selection, TARGET_SQL),
    "found_codes": (found_codes, FOUND_SQL),
}
