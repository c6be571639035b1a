"""Document fingerprints as invertible Bloom lookup tables of paragraph digests. Native DataFrame code only.

Sentences and lines (longer ones in parts) are joined to paragraphs until a part comes whose hash ends one, so an edit
changes only the paragraphs it touches. Level 0 has paragraphs of up to 8 characters, and each further level about twice
as long ones. A text's own level depends on its length and gives about 8 to 16 paragraphs; its fingerprint has this level
and the next two. At each level every distinct paragraph's 64-bit digest goes into one cell of each of three subtables; a
cell holds a count, the XOR of its digests and the XOR of their check hashes. A table is as large as it must be to give
its own digests back: at least one cell of each subtable for each digest, and twice as many wherever peeling gets stuck.

Two fingerprints are compared at the higher of their own levels. Their tables are brought to one size and subtracted cell
by cell; cells that hold one digest are peeled off until nothing is left, which gives the digests that differ. Where
peeling gets stuck, it is tried again with two to eight times that size. A table is made smaller by folding; digests for a
larger one come from peeling the fingerprint alone, so the two fingerprints are all that is needed. Likeness is 1 - differing / (digests of both): the same both ways, 1 for two empty texts, and 0 for
texts whose levels are more than two apart (one is at least four times as long as the other).

Null texts count as empty. Rows with a null id are left out. Ids may be any 64-bit numbers. "Next" goes by descending id
(ties and repeated rows in the order of the texts), and after the last comes the first; a single row is its own next.
Texts of any length are read whole. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import id_bucket, table

#: Least cells of a subtable (a power of two); rounds of peeling; doublings of the size when peeling gets stuck.
LEAST, ROUNDS, DOUBLINGS = 8, 24, 3
#: Characters up to which a text is of level 0; levels of a fingerprint; characters of a part of a sentence.
FIRST, LEVELS, PART = 128, 3, 64


def own_level(n_chars: Column) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(n_chars, F.lit(1)) / FIRST)), F.lit(0)).cast("int")


def most(level: str) -> str:
    """Most characters of a part at a level."""
    return f"least(8 * cast(pow(2, least({level}, 3)) AS int), {PART})"


def grain(level: str) -> str:
    """Of so many parts about one ends a paragraph."""
    return f"cast(pow(2, greatest({level} - 2, 0)) AS int)"


def parts(text: str, limit: str) -> Column:
    """Sentences and lines, those over ``limit`` characters in parts."""
    return F.expr(f"regexp_extract_all({text}, concat('[^.!?\\n]{{1,', {limit}, '}}[.!?\\n]*|[.!?\\n]+'), 0)")


def digests(parts_of: str, grain: str) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    marked = f"transform({parts_of}, p -> if(pmod(xxhash64(p), {grain}) = 0, concat(p, '\u0001'), p))"
    return F.expr(f"array_distinct(transform(filter(split(array_join({marked}, ''), '\u0001'), p -> p <> ''), p -> xxhash64(p)))")


def placed(keys: Column) -> Column:
    """Digests with their check hash and, for each subtable, the 21 bits whose last ones choose the cell."""
    bits = lambda x, i: F.shiftrightunsigned(x, 21 * i).bitwiseAND(F.lit(2097151))
    return F.transform(keys, lambda x: F.struct(x.alias("k"), F.xxhash64(x).alias("h"), *[bits(x, i).alias(name) for i, name in enumerate("abc")]))


def _let(value: str, name: str, then: str) -> str:
    """``then``, in which ``name`` stands for the value (worked out once)."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _cells(m: str, cell: str) -> str:
    """The expression ``cell`` for every cell; in it, ``meets`` is the test of an entry e, ``place`` the cell's number.
    ``m`` is the number of cells of a subtable less one."""
    third = (f"transform(sequence(0L, {m}), j -> {cell.replace('meets', f'e.{name} = j').replace('place', f'cast(j + {i} * ({m} + 1) AS int)')})" for i, name in enumerate("abc"))
    return f"concat({', '.join(third)})"


def sketch(entries: str, m: str) -> str:
    """The cells of the table of the entries."""
    start = "named_struct('n', 0, 'k', 0L, 'h', 0L)"
    put = "named_struct('n', s.n + 1, 'k', s.k ^ e.k, 'h', s.h ^ e.h)"
    dealt = f"transform({entries}, e -> named_struct('k', e.k, 'h', e.h, 'a', e.a & {m}, 'b', e.b & {m}, 'c', e.c & {m}))"
    return _let(dealt, "es", _cells(m, f"aggregate(filter(es, e -> meets), {start}, (s, e) -> {put})"))


def peeled(cells: str, m: str) -> str:
    """The number of digests that peeling recovers from a difference of two tables, or null if it gets stuck."""
    places = ", ".join(f"'{name}', shiftrightunsigned(x.k, {21 * i}) & 2097151 & {m}" for i, name in enumerate("abc"))
    pure = f"array_distinct(transform(filter(s.c, x -> abs(x.n) = 1 AND x.h = xxhash64(x.k)), x -> named_struct('k', x.k, 'n', x.n, 'h', x.h, {places})))"
    take = "aggregate(filter(p, e -> meets), element_at(s.c, place + 1), (t, y) -> named_struct('n', t.n - y.n, 'k', t.k ^ y.k, 'h', t.h ^ y.h))"
    step = f"if(s.left, {_let(pure, 'p', f'''named_struct('c', if(size(p) = 0, s.c, {_cells(m, take)}), 'd', s.d + size(p), 'left', size(p) > 0)''')}, s)"
    end = "if(forall(s.c, x -> x.n = 0 AND x.k = 0 AND x.h = 0), s.d, cast(null AS int))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {cells}, 'd', 0, 'left', true), (s, r) -> {step}, s -> {end})"


def least_size(n: str) -> str:
    return f"cast(greatest({LEAST}, pow(2, ceil(log2(greatest({n}, 1))))) AS bigint)"


def table_of(entries: str) -> Column:
    """The table of the digests, so large that it gives all of them back: cells, and the cells of a subtable less one (m)."""
    found = "named_struct('m', m, 'cells', cells)"
    sizes = [f"{least_size(f'size({entries})')} * {1 << i} - 1" for i in range(DOUBLINGS + 1)]
    tries = [_let(m, "m", _let(sketch(entries, "m"), "cells", f"if({peeled('cells', 'm')} IS NULL, null, {found})")) for m in sizes[:-1]]
    last = _let(sizes[-1], "m", _let(sketch(entries, "m"), "cells", found))
    return F.expr(f"if({entries} IS NULL, null, coalesce({', '.join([*tries, last])}))")


def differing(a: str, b: str, table: str, m: str) -> str:
    """The number of digests that differ, from the difference of two tables of one size, or null if peeling gets stuck.
    ``table`` is the first one's own, which serves where it has this size."""
    cells = f"if({table}.m = {m}, {table}.cells, {sketch(a, m)})"
    return peeled(f"zip_with({cells}, {sketch(b, m)}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))", m)


def likeness(a: str, b: str, table: str) -> Column:
    """From the digests that two fingerprints hold: the first size at which the difference can be peeled.

    Whether a smaller size would do has no influence on what is found, so the first one is that of the larger fingerprint.
    """
    first = least_size(f"greatest(size({a}), size({b}))")
    tries = ", ".join(_let(f"{first} * {1 << i} - 1", "m", differing(a, b, table, "m")) for i in range(DOUBLINGS + 1))
    exact = f"size(array_except({a}.k, {b}.k)) + size(array_except({b}.k, {a}.k))"  # of what peeling each alone gives
    return F.expr(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0D WHEN size({a}) + size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D WHEN {a} = {b} THEN 1D ELSE 1D - coalesce({tries}, {exact}) / (size({a}) + size({b})) END")


def written(level: str, entries: str, t: str) -> str:
    """One level of a fingerprint: level, number of digests, cells of a subtable, and for each cell that isn't empty its
    count, digests and checks."""
    cell = "if(x.n = 0 AND x.k = 0 AND x.h = 0, '', concat_ws(':', x.n, lower(hex(x.k)), lower(hex(x.h))))"
    return f"concat({level}, ' ', size({entries}), ' ', {t}.m + 1, ' ', array_join(transform({t}.cells, x -> {cell}), ','))"


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``next``, the text that follows by descending id, without a sort of all rows in one task."""
    docs = docs.withColumn("_bucket", id_bucket(docs, "doc_id"))
    within = Window.partitionBy("_bucket").orderBy(F.desc("doc_id"), F.asc("text"))
    # ~x falls as x rises, for any 64-bit number
    heads = docs.groupBy("_bucket").agg(F.min_by("text", F.struct(F.bitwise_not("doc_id"), "text")).alias("_head"))
    every = Window.orderBy(F.desc("_bucket"))  # one row for each bucket, of which there are a fixed number
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = heads.select("_bucket", F.coalesce(F.lead("_head").over(every), F.first("_head").over(whole)).alias("_head"))
    return docs.withColumn("_next", F.lead("text").over(within)).join(chain, "_bucket").withColumn("next", F.coalesce("_next", "_head")).drop("_bucket", "_next", "_head")


def with_parts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the level of a text and its parts at this level and the next ones."""
    level = f"{name}_level"
    docs = docs.withColumn(level, own_level(F.char_length(text))).withColumn(f"{name}_p0", parts(text, most(level)))
    for i in range(1, LEVELS):
        same = F.expr(f"{most(level)} = {most(f'{level} + {i}')}")
        docs = docs.withColumn(f"{name}_p{i}", F.when(same, F.col(f"{name}_p0")).otherwise(parts(text, most(f"{level} + {i}"))))
    return docs


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of the rows of ``docs`` (doc_id, text), of their edited texts, and the likeness to those and to the next."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    part = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - part).cast("int")), F.substring("next", F.lit(1), part)))
    docs = with_parts(with_parts(docs, "text", "a"), "edited", "e")
    docs = docs.withColumn("n_level", own_level(F.char_length("next"))).withColumn("level", F.greatest("a_level", "n_level"))
    docs = docs.withColumn("np", F.when(F.col("level") - F.col("n_level") < LEVELS, parts("next", most("level"))))
    keep = ["doc_id", "n_chars", "a_level", "e_level", "level"]
    each = [f"{x}{i}" for x in "ae" for i in range(LEVELS)]
    docs = docs.select(
        *keep,
        F.sha2("edited", 256).alias("edited_sha256"),
        *[placed(digests(f"{x}_p{i}", grain(f"{x}_level + {i}"))).alias(f"{x}{i}") for x in "ae" for i in range(LEVELS)],
        F.when(F.col("np").isNotNull(), placed(digests("np", grain("level")))).alias("n"),
    )
    docs = docs.select("*", *[table_of(x).alias(f"t_{x}") for x in each])
    at = lambda name, level, own: F.expr("CASE " + " ".join(f"WHEN {level} - {own} = {i} THEN {name}{i}" for i in range(LEVELS)) + " END")
    both = "greatest(a_level, e_level)"
    pick = {"xa": ("a", both, "a_level"), "t_xa": ("t_a", both, "a_level"), "xe": ("e", both, "e_level"), "ya": ("a", "level", "a_level"), "t_ya": ("t_a", "level", "a_level")}
    docs = docs.select("*", *[at(*x).alias(name) for name, x in pick.items()])
    text = lambda x: F.expr("concat_ws('|', " + ", ".join(written(f"{x}_level + {i}", f"{x}{i}", f"t_{x}{i}") for i in range(LEVELS)) + ")")
    return docs.select("doc_id", "n_chars", "edited_sha256", text("a").alias("fingerprint"), text("e").alias("edited_fingerprint"), likeness("xa", "xe", "t_xa").alias("near_edited"), likeness("ya", "n", "t_ya").alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document beside those of its edited text and of the next document."""
    return fingerprinted(table(spark, sf_dir, "documents"))
