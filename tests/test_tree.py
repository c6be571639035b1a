"""Ways up trees with cycles, ambiguous and missing parents beside a recursive query and a plain walk."""

import random

from corvane.operators import tree


def walked(rows, start):
    count = {}
    for k, p, *_ in rows:
        count.setdefault(k, []).append(p)
    way, at = [], start
    while True:
        if at is None:
            return way, "root"
        if at in way:
            return way, "cycle"
        if at not in count:
            return way, "missing"
        if len(count[at]) > 1:
            return way, "ambiguous"
        way.append(at)
        at = count[at][0]


def test_ways_up(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 40 == 0 else i - 1) for i in range(200)]  # chains of 40
    rows += [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400 + i, 300 + i % 7) for i in range(20)] + [(500, 500)]
    rows += [(600, 5), (600, 6), (601, 600), (602, 601), (603, 999), (None, 4)] + [(700 + i, rng.choice([700 + rng.randrange(60), None, 600, 999])) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, p bigint").repartition(3)
    got = {r.key: (r.way, r.ended) for r in tree.ways_up(df, "k", "p").collect()}
    unique = [k for k, _ in rows if k is not None and sum(x == k for x, _ in rows) == 1]
    assert got == {k: walked([r for r in rows if r[0] is not None], k) for k in unique}
    # the same from a recursive query
    sql = spark.sql("""WITH RECURSIVE n AS (SELECT k, min(p) AS p FROM {t} WHERE k IS NOT NULL GROUP BY k HAVING count(*) = 1),
      up AS (SELECT k AS key, array(k) AS way, p FROM n UNION ALL SELECT key, array_append(way, n.k), n.p FROM up JOIN n ON n.k = up.p WHERE NOT array_contains(way, n.k))
      SELECT key, max_by(way, size(way)) AS way FROM up GROUP BY key""", t=df)
    assert {r.key: r.way for r in sql.collect()} == {k: w for k, (w, _) in got.items()}
    assert tree.ways_up(df.limit(0), "k", "p").count() == 0
    kinds = {(r.ended, r.length): r.n_keys for r in tree.chains(tree.ways_up(df.where("k < 200"), "k", "p")).collect()}
    assert kinds == {("root", n): 5 for n in range(1, 41)}


def test_intros(spark):
    rows = [(1, "1", "top "), (2, "1.2", "x" * 31), (3, "1.2.3", "third"), (4, "1.2.3.4", "own"), (5, "2.1.1", "under nothing"), (6, "3", "a"), (7, "3", "b"), (8, "3.1", "c"), (9, "3.1.1", "d"), (10, "4", None), (11, "4.1", "e"), (12, None, "no code"), (13, "1.2.9.9", "skips a level")]
    df = tree.dotted_parents(spark.createDataFrame(rows, "id bigint, code string, text string"), "code")
    got = {r.id: (r.parent_intro, r.index_text) for r in tree.with_intros(df, "id", "code", "parent", "text", 30).collect()}
    assert got == {
        1: (None, "top "), 2: ("top", "top\n" + "x" * 31), 3: ("top", "top\nthird"), 4: ("third", "top\nthird\nown"), 5: (None, "under nothing"), 6: (None, "a"), 7: (None, "b"),
        8: (None, "c"), 9: ("c", "c\nd"), 10: (None, ""), 11: ("", "e"), 12: (None, "no code"), 13: ("top", "top\nskips a level"),
    }
