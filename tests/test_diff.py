"""Opcodes beside the standard library's alignment and by what they are for: making the new edition from the old."""

import difflib
import random

from pyspark.sql import functions as F

from corvane.operators import diff
from corvane.plans import integrity
from tests.compare import oracle, rows


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde ") for _ in range(rng.randrange(25))] for _ in range(2))
        found = diff.aligned(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) == lcs(a, b)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))
        assert diff.longest_chain(*map(list, zip(*enumerate(rng.sample(range(30), 20))))) != []


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randrange(6)):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            out[at:at] = [f"new {rng.randrange(99)}"] * rng.randrange(1, 4)
        elif kind == 1:
            del out[at : at + rng.randrange(1, 5)]
        elif kind == 2:
            out[at : at + 2] = [f"changed {rng.randrange(99)}", ""]
        else:
            out[at:at] = out[:3]
    return out


def test_patches_make_the_new_edition(spark):
    rng = random.Random(5)
    pairs = {}
    for p in range(40):
        old = [rng.choice(["", "# A", "# B", f"line {rng.randrange(60)}", f"own {p} {i}"]) for i in range(rng.randrange(60))]
        pairs[p] = (old, edited(rng, old))
    pairs |= {50: ([], ["a", "b"]), 51: (["a", None], []), 52: (["x"] * 300, ["x"] * 200 + ["y"]), 53: ([f"l{i}" for i in range(500)], [f"l{i}" for i in range(499, -1, -1)]), 54: (["a", None, "b"], ["a", None, "c"])}
    schema = "pair bigint, place int, line string"
    rows = lambda k: spark.createDataFrame([(p, i, x) for p, e in pairs.items() for i, x in enumerate(e[k])], schema).repartition(3)
    old, new = rows(0), rows(1)
    ops = diff.opcodes(old, new).cache()
    by_pair = {}
    for r in ops.collect():
        by_pair.setdefault(r.pair, []).append((r.old_from, r.old_to, r.new_from, r.new_to, r.tag))
    made = {r.pair: r.lines for r in diff.applied(old, diff.patch(ops, new)).collect()}
    for p, (a, b) in pairs.items():
        if not a and not b:
            continue
        i = j = 0
        for i1, i2, j1, j2, tag in sorted(by_pair[p]):
            assert (i1, j1) == (i, j) and tag == ("equal" if a[i1:i2] == b[j1:j2] else "replace" if i2 > i1 and j2 > j1 else "delete" if i2 > i1 else "insert")
            i, j = i2, j2
        assert (i, j) == (len(a), len(b)) and made[p] == b
        tags = [o[4] for o in sorted(by_pair[p])]
        assert all(x != y or x != "equal" for x, y in zip(tags, tags[1:]))
    assert sorted(by_pair[52]) == [(0, 200, 0, 200, "equal"), (200, 300, 200, 201, "replace")]
    sections = diff.by_section(ops, new, F.when(F.startswith("line", F.lit("# ")), F.col("line")))
    total = sections.groupBy("pair").agg(F.sum("removed").alias("r"), F.sum("added").alias("a")).collect()
    for t in total:
        same = sum(o[1] - o[0] for o in by_pair[t.pair] if o[4] == "equal")
        assert (t.r, t.a) == (len(pairs[t.pair][0]) - same, len(pairs[t.pair][1]) - same)


def test_counts_by_section_as_the_standard_library_has_them(spark):
    """Editions whose changed lines are unique have one alignment, so the counts are those of difflib's opcodes."""
    rng = random.Random(6)
    pairs = {}
    for p in range(12):
        old = [f"# S{i // 10}" if i % 10 == 0 else f"{p} line {i}" for i in range(80)]
        new = [x if rng.random() > 0.1 or x[0] == "#" else f"{x} edited" for x in old if rng.random() > 0.05 or x[0] == "#"]
        pairs[p] = (old, new)
    schema = "pair bigint, place int, line string"
    rows = lambda k: spark.createDataFrame([(p, i, x) for p, e in pairs.items() for i, x in enumerate(e[k])], schema)
    got = {(r.pair, r.section): (r.removed, r.added) for r in diff.by_section(diff.opcodes(rows(0), rows(1)), rows(1), F.when(F.startswith("line", F.lit("#")), F.col("line"))).collect()}
    want = {}
    for p, (a, b) in pairs.items():
        at, last = {}, "?"
        for k, x in enumerate(b):
            last = x if x[0] == "#" else last
            at[k] = last
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
            if tag != "equal":
                for k in range(j1, j2):
                    r, n = want.get((p, at[k]), (0, 0))
                    want[p, at[k]] = (r, n + 1)
                if i2 > i1:
                    r, n = want.get((p, at.get(j1, "?")), (0, 0))
                    want[p, at.get(j1, "?")] = (r + i2 - i1, n)
    assert got == want


def pages(spark, path):
    """Editions of many small chunks: lines that both hold once, foreign ones between, one edition that is missing and one that is null."""
    html = lambda p: None if p == 8 else "".join(f"<p>{i} {p // 2}" + (f"<b>{p % 2}" if i % 3 == 0 else "<i>same") for i in range(40))
    spark.createDataFrame([(p, f"u{p}", html(p)) for p in range(21)], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def grouped_calls(df) -> int:
    """Steps of the plan that call Python for each group."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsIn")


def test_line_opcodes_call_python_by_batches(spark, tmp_path):
    df = integrity.line_opcodes(spark, pages(spark, tmp_path))
    got = sorted((r.pair, r.old_from, r.old_to, r.new_from, r.new_to, r.tag) for r in df.collect())
    assert grouped_calls(df) == 0
    one = [g[1:] for g in got if g[0] == 3]
    assert [o for o in one if o[-1] == "replace"] == [(n, n + 1, n, n + 1, "replace") for n in range(1, 80, 6)] and len(one) == 28
    assert [g for g in got if g[0] in (4, 10)] == [(4, 0, 0, 0, 80, "insert"), (10, 0, 80, 0, 0, "delete")]


def test_null_lines_and_equal_chunks(spark):
    sides = [[None, "a", None, "x", "x", "b"], [None, "a", None, "x", "y", "x", "b"]]
    old, new = (spark.createDataFrame([("p", i, s) for i, s in enumerate(lines)], "pair string, place int, line string") for lines in sides)
    got = sorted((r.old_from, r.old_to, r.new_from, r.new_to, r.tag) for r in diff.opcodes(old, new).collect())
    assert got == [(0, 4, 0, 4, "equal"), (4, 4, 4, 5, "insert"), (4, 6, 5, 7, "equal")]


def test_section_changes_call_python_by_batches(spark, tmp_path):
    df = integrity.section_changes(spark, pages(spark, tmp_path))
    got = {r.pair: (r.section, r.removed, r.added) for r in df.collect()}
    assert grouped_calls(df) == 0
    assert got == {p: ("?", 0 if p == 4 else 80 if p == 10 else 14, 80 if p == 4 else 0 if p == 10 else 14) for p in range(11)}


def test_patched_editions_call_python_by_batches(spark, tmp_path):
    path = pages(spark, tmp_path)
    old, new = integrity._page_editions(spark, path)
    assert grouped_calls(diff.applied(old, diff.patch(diff.opcodes(old, new), new))) == 0
    df = integrity.patched_editions(spark, path)
    rel = oracle(path).sql(integrity.PATCHED_SQL)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
