"""Positional differences of two editions, line by line: opcodes, patches, changes by section.

Lines that both editions hold exactly once are anchors; the longest chain of anchors in the same order on both sides stays
(a patience diff). Between two anchors lies a chunk, and each chunk is aligned by itself, by a longest common subsequence with
bit vectors. Anchors are found by an aggregation, chains by pair, chunks anywhere: long editions are spread by their chunks. A
chunk without anchors inside holds repeated or foreign lines only; foreign ones are set aside before it is aligned.

Editions are tables of ``pair``, ``place`` (from 0 on, without gaps) and ``line``. A null line equals a null line. A pair with one
edition is one insertion or deletion; repeated places are an error of the input that isn't looked for.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_chain(i: list[int], j: list[int]) -> list[int]:
    """Which of the anchors (ascending i) form the longest chain with ascending j."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, y in enumerate(j):
        at = bisect_left(tails, y)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            ends.append(n)
        else:
            tails[at], ends[at] = y, n
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(n)
        n = before[n]
    return chain[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists, ascending."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    at: dict = {}
    for n, i in enumerate(x):
        at[a[i]] = at.get(a[i], 0) | 1 << n
    # a zero at n: the subsequence grows by the n-th line of a
    full = (1 << len(x)) - 1
    state, states = full, []
    for j in y:
        grown = state & at[b[j]]
        state = ((state + grown) | (state - grown)) & full
        states.append(state)
    middle, row, col = [], len(y), len(x)
    while row and col:
        if states[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or states[row - 1] >> (col - 1) & 1:
                col -= 1
                middle.append((x[col], y[row]))
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - n, len(b) - n) for n in range(tail, 0, -1)]


def _runs(matches: list[tuple[int, int]], n: int, m: int) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of two lists of n and m lines from their matches."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y in [*matches, (n, m)]:
        if (x, y) != (i, j):
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        if x < n:
            if out and out[-1][0] == "equal" and out[-1][2] == x and out[-1][4] == y:
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def opcodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """pair, tag (equal, replace, delete, insert), old_from, old_to, new_from, new_to: half-open ranges that cover both editions."""
    both = old.select("pair", F.lit(0).alias("side"), "place", "line").unionByName(new.select("pair", F.lit(1).alias("side"), "place", "line"))
    side = lambda n: F.col("side") == n
    once = both.groupBy("pair", "line").agg(*[F.count_if(side(n)).alias(f"n{n}") for n in (0, 1)], *[F.min(F.when(side(n), F.col("place"))).cast("bigint").alias(f"p{n}") for n in (0, 1)])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(i, j, longest_chain(i, j)) for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)]
            sides = [pa.array([[x[k][n] for n in x[2]] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("pair"), *sides], ["pair", "i", "j"])

    # pairs and chunks are small and many, so they are rows of a batch, not groups of their own
    pair = old.schema["pair"].dataType.simpleString()
    in_order = lambda c, of: F.transform(F.array_sort(F.collect_list(c)), lambda x: x[of])
    lone = F.struct("p0", "p1")
    lists = once.where("n0 = 1 AND n1 = 1").groupBy("pair").agg(in_order(lone, "p0").alias("i"), in_order(lone, "p1").alias("j"))
    chains = lists.mapInArrow(chained, f"pair {pair}, i array<bigint>, j array<bigint>")
    anchors = chains.select("pair", F.explode(F.arrays_zip("i", "j")).alias("_a")).select("pair", F.col("_a.i").alias("p0"), F.col("_a.j").alias("p1"))
    # an anchor begins a chunk on both sides
    marks = anchors.select("pair", F.posexplode(F.array("p0", "p1")).alias("side", "place")).withColumn("_anchor", F.lit(1))
    marked = both.withColumn("place", F.col("place").cast("bigint")).join(marks, ["pair", "side", "place"], "left")
    order = Window.partitionBy("pair", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    chunks = marked.select("pair", "side", "place", "line", F.sum(F.coalesce("_anchor", F.lit(0))).over(order).alias("chunk"))

    def diffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ops = [], []
            for at, (i, j, n, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("i", "j", "n", "a", "b")], strict=True)):
                runs = [("equal", 0, n, 0, n)] if a is None else _runs(aligned(a, b), len(a), len(b))
                row += [at] * len(runs)
                ops += [(tag, i + i0, i + i1, j + j0, j + j1) for tag, i0, i1, j0, j1 in runs]
            columns = [pa.array([o[k] for o in ops], kind) for k, kind in enumerate([pa.string(), *[pa.int64()] * 4])]
            yield pa.RecordBatch.from_arrays([batch.column("pair").take(pa.array(row, pa.int64())), *columns], ["pair", "tag", "old_from", "old_to", "new_from", "new_to"])

    piece = lambda n: F.when(side(n), F.struct("place", "line"))
    first = lambda n: F.coalesce(F.min(F.when(side(n), F.col("place"))), F.lit(0).cast("bigint"))
    rows = chunks.groupBy("pair", "chunk").agg(first(0).alias("i"), first(1).alias("j"), in_order(piece(0), "line").alias("a"), in_order(piece(1), "line").alias("b"))
    # chunks that are equal as wholes come without their lines
    other = ~F.col("a").eqNullSafe(F.col("b"))
    rows = rows.select("pair", "i", "j", F.size("a").cast("bigint").alias("n"), F.when(other, F.col("a")).alias("a"), F.when(other, F.col("b")).alias("b"))
    ops = rows.mapInArrow(diffed, f"pair {pair}, tag string, old_from bigint, old_to bigint, new_from bigint, new_to bigint")
    # equal runs go on over the borders of chunks
    w = Window.partitionBy("pair").orderBy("old_from", "new_from", "old_to")
    goes_on = (F.col("tag") == "equal") & (F.lag("tag").over(w) == "equal") & (F.lag("old_to").over(w) == F.col("old_from")) & (F.lag("new_to").over(w) == F.col("new_from"))
    runs = ops.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    ends = [F.min("old_from").alias("old_from"), F.max("old_to").alias("old_to"), F.min("new_from").alias("new_from"), F.max("new_to").alias("new_to")]
    return runs.groupBy("pair", "_run", "tag").agg(*ends).drop("_run")


def patch(ops: DataFrame, new: DataFrame) -> DataFrame:
    """The opcodes with the lines that they bring (``lines``): what is needed, beside the old edition, to make the new one."""
    texts = new.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("_new"))
    lines = F.when(F.col("tag").isin("insert", "replace"), F.slice("_new", (F.col("new_from") + 1).cast("int"), (F.col("new_to") - F.col("new_from")).cast("int")))
    return ops.join(texts, "pair", "left").withColumn("lines", lines).drop("_new")


def applied(old: DataFrame, patches: DataFrame) -> DataFrame:
    """pair and ``lines`` of the edition that the patches make of the old one."""
    texts = old.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("_old"))
    steps = patches.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("new_from", "old_from", "tag", "old_to", "lines"))).alias("_ops"))
    kept = lambda o: F.slice("_old", (o["old_from"] + 1).cast("int"), (o["old_to"] - o["old_from"]).cast("int"))
    none = F.array().cast("array<string>")
    part = lambda o: F.when(o["tag"] == "equal", kept(o)).when(o["tag"] == "delete", none).otherwise(o["lines"])
    return steps.join(texts, "pair", "left").select("pair", F.flatten(F.transform("_ops", part)).alias("lines"))


def by_section(ops: DataFrame, new: DataFrame, heading: Column) -> DataFrame:
    """pair, section, removed, added: changed lines by the section of the new edition, the last line before or at them that
    ``heading`` gives a value for ('?' before the first). Removed lines count where they are missing."""
    w = Window.partitionBy("pair").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    known = new.select("pair", F.col("place").cast("bigint").alias("new_from"), F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("?")).alias("section"))
    changed = ops.where("tag <> 'equal'")
    more = changed.where("new_to > new_from").select("pair", F.explode(F.sequence("new_from", F.col("new_to") - 1)).alias("new_from"), F.lit(0).cast("bigint").alias("removed"), F.lit(1).cast("bigint").alias("added"))
    less = changed.where("old_to > old_from").select("pair", "new_from", (F.col("old_to") - F.col("old_from")).alias("removed"), F.lit(0).cast("bigint").alias("added"))
    placed = more.unionByName(less).join(known, ["pair", "new_from"], "left")
    return placed.groupBy("pair", F.coalesce("section", F.lit("?")).alias("section")).agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"))
