"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None

from corvane.llm import bpe, embedding_dedup, fingerprints, fm_dedup, html_text, minhash_dedup, mixing, quality, suffix_dedup, url_reputation
from tests.llm import brute

DOCS = "doc_id bigint, text string"
WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, more string, position int, slot int, rep int, _source string"


def sentences(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Texts that share passages, copies, near copies, short, empty, null and one long text."""
    rng = random.Random(7)
    passages = [sentences(rng, 60) for _ in range(4)]
    out = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = sentences(rng, 80) + " " + passages[i % 4] + "\n" + sentences(rng, 30)
        elif kind == 1:
            t = out[-1][1]
        elif kind == 2:
            w = out[-1][1].split(" ")
            w[5], w[40] = "changed", "words"
            t = " ".join(w)
        elif kind == 3:
            t = rng.choice(["", None, "one", "two words", "ABC", "abc", "  \n ", "ÄÖ é", "a b c"])
        else:
            t = sentences(rng, 50) + passages[(i + 1) % 4]
        out.append((i, t))
    out.append((60, " ".join(passages * 30)))
    out.append((61, "same word " * 3000))
    return out


def rows(spark, docs):
    """The documents in three partitions, with a row without an id."""
    return spark.createDataFrame([*docs, (None, "no id")], DOCS).repartition(3)


def wide(spark, docs):
    data = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), i, "x", i, i, i, "y") for i, t in docs]
    return spark.createDataFrame(data, WIDE).repartition(3)


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(rows(spark, docs)).collect()}
    assert got == brute.suffix_dedup(docs)


def test_suffix_kept_text_and_columns(spark, docs):
    kept = suffix_dedup.deduplicated(wide(spark, docs)).collect()
    for r in kept:
        assert r.n_removed or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
        assert (r.slot, r.position, r._source) == (r.doc_id, r.doc_id, "y")


def test_suffix_cut_characters(spark):
    a, b = "é" * 80, "x" + "é" * 80 + "y"
    out = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame([(1, a), (2, b)], DOCS)).collect()}
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in out.items()} == brute.suffix_dedup([(1, a), (2, b)])
    assert out[2].text == "xy"


def test_loser_tree_merges_as_a_sort():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    runs = []
    for i in range(7):
        run = sorted(words[i::7])
        runs.append((run, suffix_dedup.front_coded(run)[0]))
        assert suffix_dedup.front_decoded(*suffix_dedup.front_coded(run)) == run
    out = [(runs[r][0][i], k) for r, i, k in suffix_dedup.merged(runs)]
    assert [t for t, _ in out] == sorted(words)
    assert [k for _, k in out] == [suffix_dedup.common(a, b) for a, b in zip([b"", *sorted(words)], sorted(words))]


def test_substring_dedup(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.deduplicated(rows(spark, docs)).collect()}
    assert got == brute.substring_dedup(docs)


@pytest.mark.parametrize("hot", [4096, 3])
def test_one_passage_in_many_surroundings(spark, monkeypatch, hot):
    """Short and long passages between other words each time; few occurrences make an anchor hot in the second run."""
    monkeypatch.setattr("corvane.llm.repeats.HOT", hot)
    rng = random.Random(13)
    passages = [sentences(rng, n) for n in (4, 12, 22, 34, 40, 70)]
    data = [(i, sentences(rng, rng.randrange(0, 40)) + rng.choice(["", " "]) + passages[i % 6] + rng.choice(["", " x", " yy "]) + sentences(rng, rng.randrange(0, 40))) for i in range(120)]
    data += [(1000 + i, data[i][1]) for i in range(8)] + [(2000, passages[5] * 9), (-7, passages[4] + " " + passages[5])]
    # the same strings several times in one text, cut differently
    data += [(3000 + i, " ".join(passages[rng.randrange(2, 6)][rng.randrange(0, 60) :] for _ in range(12))) for i in range(8)]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
    assert got == brute.suffix_dedup(data)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.deduplicated(df).collect()}
    assert got == brute.substring_dedup(data)


def test_hot_anchor_is_spread(spark):
    """One passage in 10 000 surroundings: the parts get about equally much, and no part has all."""
    rng = random.Random(14)
    shared = sentences(rng, 20)[:90]
    data = [(i, f"{rng.getrandbits(300):x} {shared} {rng.getrandbits(300):x}") for i in range(10_000)]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    rows = suffix_dedup.repeats.dealt(df, len, suffix_dedup.LENGTH)
    anchors = suffix_dedup.repeats.repeated_anchors(rows, suffix_dedup.find_anchors)
    runs = rows.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(lambda key, a, b: suffix_dedup.contexts(key, a, b, [], 8), suffix_dedup.RUNS_SQL)
    sizes = [r.n for r in runs.where("hot IS NOT NULL").groupBy("part").agg(F.sum(F.length("hot")).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes) and runs.agg(F.sum(F.length("ids"))).first()[0] > 0
    assert suffix_dedup.deduplicated(df).agg(F.sum("n_removed")).first()[0] == 0


def test_wavelet_matrix_ranks():
    x = np.random.default_rng(1).integers(0, 37, 1000)
    w = fm_dedup.WaveletMatrix(x, 6)
    at = np.arange(0, 1001, 7)
    for s in (0, 5, 36, 40):
        lo, hi = w.ranks(np.full(len(at), s), at, np.full(len(at), 1000))
        assert lo.tolist() == [int((x[:i] == s).sum()) for i in at] and set(hi.tolist()) == {int((x == s).sum())}


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(spark, docs, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.grouped(rows(spark, docs), k).collect()}
    assert got == brute.near_dups(docs, k)


def test_minhash_large_group_of_distant_copies(spark):
    """Copies of one text with many changes, so that not all are near the first."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 7)):
            w[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.grouped(spark.createDataFrame(docs, DOCS), 4).collect()}
    assert got == brute.near_dups(docs)


def test_repeated_ids(spark, docs):
    twice = docs[:12] + docs[:12]
    df = spark.createDataFrame(twice, DOCS)
    assert suffix_dedup.deduplicated(df).count() == fm_dedup.deduplicated(df).count() == 24
    assert all(r.n_removed == r.n_words for r in fm_dedup.deduplicated(df).collect() if r.n_words >= 35)
    assert minhash_dedup.grouped(df).count() == 24
    assert mixing.mixed(wide(spark, twice).select("doc_id", "source")).count() == 24


def test_empty_tables(spark):
    docs = spark.createDataFrame([], WIDE)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    results = [
        suffix_dedup.deduplicated(docs),
        fm_dedup.deduplicated(docs),
        minhash_dedup.grouped(docs),
        fingerprints.fingerprinted(docs),
        html_text.extracted(pages),
        quality.scored(docs, quality.trained(docs, labels)),
        url_reputation.judged(pages, spark.createDataFrame([], "page_id bigint, good int"), url_reputation.RULES),
        mixing.mixed(docs.select("doc_id", "source")),
        embedding_dedup.linked(vectors),
        *([bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json")), bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))] if public_tokenizers else []),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(rows(spark, docs)).collect()}
    order = sorted(docs, reverse=True, key=lambda d: d[0])
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + following[:part]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == following:
            assert r.near_next == 1.0
    by_text = {}
    for doc_id, text in docs:
        assert by_text.setdefault(text or "", got[doc_id].fingerprint) == got[doc_id].fingerprint


def test_fingerprint_likeness_is_exact(spark):
    """Peeling finds just the digests that differ, whatever their number, and the same both ways."""
    rng = random.Random(2)
    data = []
    for n in (0, 1, 3, 10, 30, 100):
        a = [rng.getrandbits(63) for _ in range(n)]
        for m in (0, 1, n // 2, n):
            data.append((a, a[: n - m] + [rng.getrandbits(63) for _ in range(m)]))
    df = spark.createDataFrame(data, "a array<bigint>, b array<bigint>")
    df = df.select("a", "b", fingerprints.placed("a").alias("x"), fingerprints.placed("b").alias("y")).select("*", fingerprints.table_of("x").alias("tx"), fingerprints.table_of("y").alias("ty"))
    for r in df.select("a", "b", fingerprints.likeness("x", "y", "tx").alias("near"), fingerprints.likeness("y", "x", "ty").alias("back")).collect():
        total = len(r.a) + len(r.b)
        assert r.near == r.back == pytest.approx(1 - len(set(r.a) ^ set(r.b)) / total if total else 1)


def test_fingerprints_alone_give_the_likeness(spark, docs):
    """Two returned strings, read and peeled by plain Python, give near_edited and near_next."""
    rng = random.Random(8)
    more = [(100 + i, ". ".join(sentences(rng, 8) for _ in range(n)) + ".") for i, n in enumerate((3, 300, 100, 40, 41, 1, 7, 12))]
    more += [(110, more[1][1]), (111, more[1][1][:-700]), (112, more[2][1] + " one more."), (-(2**63), "least id"), (2**63 - 1, "a. b. " * 500), (10**18, None)]
    every = [*docs, *more]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(spark.createDataFrame(every, DOCS).repartition(3)).collect()}
    order = sorted(got, reverse=True)
    seen = set()
    for doc_id, then in zip(order, order[1:] + order[:1]):
        r, other = got[doc_id], got[then].fingerprint
        assert r.near_edited == pytest.approx(brute.sketch_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute.sketch_likeness(r.fingerprint, other)) == pytest.approx(brute.sketch_likeness(other, r.fingerprint))
        seen.add(round(r.near_next, 1))
    assert {0.0, 1.0} <= seen and len(seen) > 3
    assert 0.45 < got[101].near_edited < 0.85  # two thirds of a long text are as they were


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    data = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * 0.15], i % 2) for i in range(200)]
    data += [(200, data[0][1], 0), (201, data[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 1), (205, [1.0, None] * 8, 1), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").repartition(3)
    sound = [(i, np.array(v, dtype=np.float32).astype(float), l) for i, v, l in data if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, groups = {i: 0 for i, _, _ in data if i is not None}, brute.Groups([i for i, _, _ in data if i is not None])
    for x, (i, a, l) in enumerate(sound):
        for j, b, m in sound[:x]:
            if l == m and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                links[i] += 1
                links[j] += 1
                groups.link(i, j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(df, recall=1.0).collect()}
    assert got == {i: (n, groups.find(i), groups.find(i) == i) for i, n in links.items()}
    some = embedding_dedup.linked(df).collect()
    assert sum(r.n_links for r in some) >= 0.9 * sum(links.values())


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sums = (a[:, None] + b).reshape(-1)
    got = list(embedding_dedup.visited(a, b, 1.1))
    assert got == [i for i in np.argsort(sums, kind="stable").tolist() if sums[i] <= 1.1] and len(got) > 20


@pytest.mark.parametrize("rank", [3, 16])
def test_embeddings_keep_the_recall(spark, rank):
    """At the default, also where vectors differ in a few directions only; twice the same row counts twice."""
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, 32))
    near = base[:700] + rng.normal(size=(700, rank)) @ rng.normal(size=(rank, 32)) * 0.2
    v = np.concatenate((base, near, base[:20]))
    data = [(i, [float(y) for y in x], 1) for i, x in enumerate(v)] + [(5, [float(y) for y in v[5]], 1)]
    u = np.array([x for _, x, _ in data], dtype=np.float32).astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    want = int((u @ u.T >= 0.93).sum()) - len(u)
    out = embedding_dedup.linked(spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").repartition(3)).collect()
    assert len(out) == len(data) and want * 0.99 <= sum(r.n_links for r in out) <= want


def test_html(spark):
    pages = [(1, "http://a.com/x", "<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<p>d &amp; e</article><footer>f</footer>"), (2, None, None), (3, "", ""), (4, "http://a.com/y", "plain <i>te</i>xt<br>more"), (None, "u", "<p>x")]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "T a bc d & e", 12), (2, "", 0), (3, "", 0), (4, "plain text more", 15), (None, "x", 1)], key=str)


def test_html_style_tree_removes_what_repeats(spark):
    pages = [(i, f"http://h.com/{i}", f"<body><div class=box>Always the same words</div><div><p>text {i} of page {i * 7}</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"text {i} of page {i * 7}" for i in range(8)}


def test_html_style_tree_spares_the_article_and_counts_copies_once(spark):
    menu = "<div class=box>Always the same words</div>"
    answers = ["yes", "no"]
    table = lambda i: f"<table><tr><td>{answers[i % 2]}</td></tr></table><ul><li>one</li><li>two</li></ul>"
    pages = [(i, f"http://m.com/{i}", f"<body>{menu}<main><p>text {i}</p>{table(i)}</main>") for i in range(40)]
    # without a mark: many copies of one page beside pages of their own, and one page with equal list items
    plain = lambda x: f"<body>{menu}<p>text {x}</p><ul><li>first {x}</li><li>then {x}</li></ul>"
    pages += [(100 + i, f"http://c.com/{i}", plain("copy" if i < 80 else i)) for i in range(100)]
    pages += [(300, "http://l.com/", f"<body>{menu}<p>text</p><ul>{'<li>same</li>' * 5}</ul>")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert {i: got[i] for i in range(40)} == {i: f"text {i} {answers[i % 2]} one two" for i in range(40)}
    assert {i: got[100 + i] for i in range(100)} == {i: "text {0} first {0} then {0}".format("copy" if i < 80 else i) for i in range(100)}
    assert got[300] == "text same same same same same"  # a host of one page backs off to the tree of all hosts


def test_html_style_tree_equals_a_plain_one(spark):
    """On generated sites of many and few pages: the same importance, and the same texts."""
    rng = random.Random(12)
    pages = []
    for i in range(150):
        host = f"h{min(int(rng.expovariate(0.5)), 6)}.com"
        menu = " ".join(f"<li><a href=/{x}>{x}</a></li>" for x in rng.sample(["news", "sport", "mail", "home", "shop"], 4))
        named = rng.choice(["notice", "legal", "box", "side story", "promo"])
        body = "".join(f"<p>{sentences(rng, 12)}</p>" for _ in range(3))
        box = f"<div class='{named}'>{rng.choice(['one line', 'and another line of it']) if i % 3 else sentences(rng, 8)}</div>"
        frame = f"<article>{body}</article>" if i % 4 else f"<div class=page>{body}</div>"
        pages.append((i, f"http://{host}/{i}", f"<body><nav><ul>{menu}</ul></nav>{box}{frame}<footer>of {host}, all rights</footer>" if i % 50 else None))
    pages += pages[:20]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    want = brute.style_tree([(u.split("/")[2], h) for _, u, h in pages], html_text.features)
    tree = {}
    for r in html_text.style_tree(html_text.hosted(df)).where("importance IS NOT NULL").collect():
        tree.setdefault(r.host, {})[r.path] = r.importance
    assert {h: sorted(t) for h, t in tree.items()} == {h: sorted(t) for h, t in want.items() if t}
    assert all(tree[h][p] == pytest.approx(x) for h, t in want.items() for p, x in t.items())
    got = sorted((r.page_id, r.text) for r in html_text.extracted(df).collect())
    assert got == sorted((i, html_text.main_text(h, want.get(u.split("/")[2], {}))) for i, u, h in pages)


def test_html_importance_decides_and_not_names(spark):
    """Blocks with names that mostly stand beside the article stay if they differ, and go if they repeat."""
    pages = []
    for i in range(12):
        own = sentences(random.Random(i), 20)
        pages.append((i, "http://a.com/", f"<body><div class='post legal'><p>own {own}</p></div><div class=notice>{'same on all pages' if i % 2 else 'the other line'}</div>"))
        pages.append((100 + i, "http://b.com/", f"<body><div class=legal>{'<b>x</b>' * (i % 5)}{own}</div><div>nothing but this</div>"))
        pages.append((200 + i, "http://c.com/", f"<body><div class=teaser><article class=teaser>short one</article></div><div id=content>{own}</div>"))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    for i in range(12):
        own = sentences(random.Random(i), 20)
        assert got[i] == f"own {own}" and got[100 + i] == f"{'x' * (i % 5)}{own}" and got[200 + i] == own
        assert html_text.main_text(pages[3 * i][2]) != got[i] and html_text.main_text(pages[3 * i + 1][2]) != got[100 + i]  # without the tree


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_html_most_text_goes_by_entropy_alone(spark):
    """Where seeds have no say (the factor is one for all blocks), most of what is removed still goes."""
    pages = html_text.hosted(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    tree = {}
    for r in html_text.style_tree(pages).where("importance IS NOT NULL").collect():
        tree.setdefault(r.host, {})[r.path] = r.importance
    by_tree = by_entropy = 0
    for r in pages.collect():
        known = tree.get(r.host, {})
        pieces = list(html_text.Page(r.html).pieces())
        by_tree += sum(len(x) for x, block, factor, article in pieces if not html_text.kept(factor, article, known.get(block)))
        by_entropy += sum(len(x) for x, block, factor, article in pieces if block in known and factor < 1 and known[block] < html_text.THRESHOLD)
    assert by_tree > 0 and by_entropy > by_tree / 2


def test_urls(spark):
    urls = ["http://Example.COM/en/1", "https://example.com/en/7x", "x://a.net/de/8?q", "http://sub.example.net/de/8", "http://b.org/es/#f", "no scheme", None, "http://notexample.com.x/en/", "http://c.io?q=1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judged(pages, spark.createDataFrame([(8, None)], "page_id bigint, good int"), url_reputation.RULES).collect()}
    assert got[0] == ("example.com", "/en/1", "com/en/", "block") and got[1] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("a.net", "/de/8", "net/de/", "block") and got[3] == ("sub.example.net", "/de/8", "example.net/de/8", "allow")
    assert got[4][2:] == ("org/es/", "block") and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][:3] == ("notexample.com.x", "/en/", None) and got[8][:2] == ("c.io", "")
    hosts = spark.createDataFrame([("user@shop.a.co.uk:8080",), ("a.com.br",), ("b.c.example.org",), ("x",), ("",)], "host string")
    assert [tuple(r) for r in url_reputation.with_levels(hosts).select("suffix", "domain").collect()] == [("co.uk", "a.co.uk"), ("com.br", "a.com.br"), ("org", "example.org"), ("x", "x"), ("", "")]


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ["http://a.net/de/7", "http://example.net/de/7", "http://sub.example.net/de/81", "http://a.com/en/", "http://example.com/en/7", "http://b.org/es/"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.op7_url_reputation(spark, str(tmp_path)).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("com/en/", "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block")}


def test_repeated_and_null_rows_keep_their_place(spark, docs):
    """Twice the same rows give twice the same results; rows without an id are kept where the docstring says so."""
    twice = [*docs[:20], *docs[:20]]
    got = [tuple(r) for r in fingerprints.fingerprinted(spark.createDataFrame(twice, DOCS).repartition(3)).select("doc_id", "fingerprint").collect()]
    assert len(got) == 40 and len(set(got)) == 20
    pages = [(1, "http://a.com/", "<p>x"), (1, "http://a.com/", "<p>x"), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert html_text.extracted(df).count() == url_reputation.judged(df, spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "page_id bigint, good int"), url_reputation.RULES).count() == 3
    if public_tokenizers:
        out = bpe.encoded(spark.createDataFrame([*twice, (None, "no id"), (None, "x" * 70_000)], DOCS), public_tokenizers.path("word_bpe_49k.json")).collect()
        assert len(out) == 42 and len({(r.doc_id, r.ids) for r in out}) == 22


def test_bpe_round_trip(spark, docs):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    texts = [*docs, (100, "<|startoftext|> İstanbul ǅ 𝒳 don't WE'LL 12345 <|endoftext|>x\u3000y\u200b")]
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(texts, DOCS), path).collect()}
    for doc_id, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[doc_id].ids, dtype="<u4").tolist() == ids
        assert got[doc_id].decoded == t.decode(ids, skip_special_tokens=False)


def test_mixing_stays_within_a_block(spark):
    data = [(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(3000)]
    out = mixing.mixed(spark.createDataFrame(data, "doc_id bigint, source string"), {"a": 3.0, "b": 1.0, mixing.NO_SOURCE: 2.0}, block=4).collect()
    assert len(out) == 3000 and len({r.position for r in out}) == 3000
    for r in out:
        assert r.release_slot <= r.slot < r.deadline_slot


def test_mixing_keeps_to_the_exact_weights(spark):
    """Targets that aren't multiples of a thousandth: each source has its share within less than one block up to its end."""
    weights = {"a": 0.66666, "b": 0.00034, "c": 0.333}
    data = [(i, "a" if i % 3 else "c") for i in range(60_000)] + [(60_000 + i, "b") for i in range(20)]
    out = mixing.mixed(spark.createDataFrame(data, "doc_id bigint, source string"), weights, block=1).collect()
    assert len(out) == len(data) == len({r.slot for r in out})
    total = sum(weights.values())
    for r in out:
        w = weights[r.source] / total
        assert r.source_weight == pytest.approx(w, rel=1e-9)
        assert r.block_no / w - 1 < r.slot + 1e-6 and r.slot < (r.block_no + 1) / w + 1
        assert r.release_slot <= r.slot < r.deadline_slot


def test_mixing_equals_a_plain_schedule(spark):
    """Every block's slot is that of a search over all sources, slot by slot; ids far apart, repeated rows, clashing names."""
    rng = random.Random(6)
    names = [f"s{i}" for i in range(9)] + [None]
    data = [(rng.choice([rng.randrange(-(2**63), 2**63), 5, 6]), names[min(int(rng.expovariate(0.4)), 9)], "x", i, i) for i in range(900)]
    data += data[:40]
    df = spark.createDataFrame(data, "doc_id bigint, source string, _source string, position int, nr int").repartition(3)
    out = mixing.mixed(df, block=2).collect()
    assert sorted((r.doc_id, r.source or "", r._source, r.nr) for r in out) == sorted((i, s or "", x, n) for i, s, x, _, n in data)
    counts = {s: sum(1 for r in data if (r[1] or mixing.NO_SOURCE) == s) for s in {r[1] or mixing.NO_SOURCE for r in data}}
    want = brute.earliest_deadlines(mixing.whole(mixing.square_root_weights(counts)), {s: -(-n // 2) for s, n in counts.items()})
    assert {(r.source or mixing.NO_SOURCE, r.block_no): r.slot for r in out} == want
    for s in names:  # in id order
        mine = sorted((r.position, r.doc_id) for r in out if r.source == s)
        assert [i for _, i in mine] == sorted(i for _, i in mine)


def test_mixing_many_sources_and_extreme_shares(spark):
    """The deviation from the given weights stays under one block, with shares from 1e-7 to 0.99; zero weights are equal."""
    weights = {f"s{i}": 10.0 ** (-7 + 3 * i / 10_000) for i in range(10_000)}
    weights["large"] = 99 * sum(weights.values())
    whole, total = mixing.whole(weights), sum(weights.values())
    slots = mixing.schedule(whole, {s: 3000 if s == "large" else max(1, int(3000 * w / weights["large"])) for s, w in weights.items()})
    for s, xs in slots.items():
        for i, x in enumerate(xs):
            share = weights[s] / total
            assert x * share - 1 < i + 1e-6 and i < (x + 1) * share + 1e-6
    data = [(i, "abc"[i % 3]) for i in range(90)]
    assert {r.source_weight for r in mixing.mixed(spark.createDataFrame(data, "doc_id bigint, source string"), dict.fromkeys("abc", 0.0)).collect()} == {1 / 3}
    with pytest.raises(ValueError):
        mixing.whole({"a": -1.0})


def test_pipeline_hands_the_mix_on(spark, docs):
    """The last stage's rows have the place that the mixing stage gave them."""
    pytest.importorskip("public_tokenizers")
    from corvane.llm.common import stored

    df = wide(spark, docs).withColumn("Mix_Position", F.lit(-1))
    placed = stored(mixing.mixing_stage(spark, df, ""))
    assert sorted(placed.columns) == sorted([*WIDE.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", "), mixing.PLACE])
    assert {(r.doc_id, r.text, r.position, r.slot) for r in placed.collect()} == {(i, t, i, i) for i, t in docs}
    want = {r.doc_id: r.position for r in mixing.mixed(df.select("doc_id", "source")).collect()}
    assert {r.doc_id: r.position for r in bpe.bpe_stage(spark, placed, "").collect()} == want


def test_quality_keeps_good_documents(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = " ".join(rng.choice(["the", "quiet", "river", "was", "long", "and", "blue"]) + ("" if good else "!!#") for _ in range(60))
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 3:
            labels.append((i, int(good), 0))
    docs += [(1000, None, None, None, None), (1001, "", "xx", None, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = quality.trained(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r.accepted for r in quality.scored(df, model).collect()}
    assert all(got[i] == (i % 4 > 0) for i in range(400)) and len(got) == 402


def test_quality_views_teach_each_other_from_all_rows(spark):
    """What a view hands on are the surest rows of the whole table, each once, and none that is known already."""
    rng = random.Random(10)
    docs = []
    for i in range(1500):
        good = i % 3 > 0
        text = " ".join(rng.choice(["the", "quiet", "river", "was", "long", "and", "blue"]) + ("" if good or rng.random() < 0.5 else "!!#") for _ in range(40))
        docs.append((i, text, "en" if good else "xx", "s", len(text), 1.0, "x", 0.5, i))
    df = spark.createDataFrame(docs + docs[:100], "doc_id bigint, text string, lang string, source string, n_chars bigint, y double, accepted string, score double, row int").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 1500, 5)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    labelled, ids, y = quality.collected(df.select("doc_id", "text", "lang", "source", "n_chars").join(labels.where("quality IN (0, 1)").selectExpr("doc_id", "double(quality) AS y"), "doc_id"))
    assert ids == list(range(0, 1500, 5))
    views = tuple(quality.fit(x, y) for x in labelled)
    own = (np.array([1.0, 0.0]),) * 2
    got = quality.surest(df, views, own, (set(ids), set(ids)))
    content = quality.content_view([d[1].encode() for d in docs])
    metadata = quality.metadata_view([d[1].encode() for d in docs], [d[2] for d in docs], [d[3] for d in docs], [d[4] for d in docs])
    for teacher, x in ((0, content), (1, metadata)):
        chance = quality.logistic(views[teacher].odds(x))
        for c in (0, 1):
            sure = {i: s for i, s in enumerate(chance if c else 1 - chance) if s >= quality.SURE and i % 5}
            mine = [i for i, k in got[1 - teacher].items() if k == c]
            assert len(mine) == min(quality.TAUGHT, len(sure)) and min((sure[i] for i in mine), default=1) >= sorted(sure.values(), reverse=True)[: quality.TAUGHT][-1] - 1e-5
    model = quality.trained(df, labels)
    out = quality.scored(df, model).collect()
    assert len(out) == 1600 and all(r.accepted == (r.doc_id % 3 > 0) for r in out) and {r.y for r in out} == {1.0}
    kept = quality._scored(df, model).where("accepted").select("row.*")
    assert kept.columns == df.columns and {r.accepted for r in kept.collect()} == {"x"}


def test_classes_of_a_repeated_id_are_linked(spark):
    """Rows of one id join their groups, empty texts too; of a kept id the least row stays, in whatever order rows come."""
    rng = random.Random(31)
    a, b, c = (sentences(rng, 30) for _ in range(3))
    data = [(3, a), (5, a), (5, b), (9, b), (9, ""), (11, ""), (11, None), (20, ""), (20, c), (21, c), (4, c + " x")]
    for part in (1, 4):
        df = spark.createDataFrame(data, DOCS).repartition(part)
        got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.grouped(df).collect()}
        assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (4, 4, True), (20, 4, False), (21, 4, False)}
        assert sorted(tuple(r) for r in minhash_dedup.minhash_stage(spark, df, "").collect()) == [(3, a), (4, c + " x"), (11, "")]
    same = spark.createDataFrame([(1, a, "y"), (1, a, "x"), (2, a, "w")], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in minhash_dedup.minhash_stage(spark, same, "").collect()] == [(1, a, "x")]


def test_spans_inside_buckets_spread_over_parts(spark):
    """Every bucket repeats inside; its own spans don't all go to one part, and the result doesn't depend on the partitions."""
    from corvane.llm import repeats

    rng = random.Random(32)
    shared = sentences(rng, 60)
    data = [(i, sentences(rng, 10) + " " + shared + " " + sentences(rng, 10) + " " + shared) for i in range(200)]
    df = spark.createDataFrame(data, DOCS)
    rows = repeats.dealt(df, len, suffix_dedup.LENGTH)
    anchors = repeats.repeated_anchors(rows, suffix_dedup.find_anchors)
    runs = rows.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(lambda k, x, y: suffix_dedup.contexts(k, x, y, [], 8), suffix_dedup.RUNS_SQL)
    assert runs.where("spans IS NOT NULL").select("part").distinct().count() == 8
    want = brute.suffix_dedup(data)
    for n in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
        assert got == want
    assert suffix_dedup.suffix_stage(spark, df, "").columns == ["doc_id", "text"]


def test_bad_hosts_domains_and_suffixes_are_blocked(spark):
    """One bad host with many labels, one bad domain of thin hosts and one bad suffix of thin domains; each is blocked by its own
    level, unlabelled hosts below them too, and nothing else is."""
    urls, good = [], []
    for i in range(200):
        for j in range(10):
            urls.append(f"http://h{i % 5}.site{i // 5}.com/{j}")
            good.append(int(j > 0))
    for j in range(600):
        urls.append(f"http://g{j % 20}.site1.com/{j}" if j % 10 else f"http://bad.site1.com/{j}")
        good.append(int(j % 10 > 0 and j % 11 > 0))
    for i in range(60):
        urls += [f"http://h{i}.thin.com/", f"http://www.d{i}.spam/"]
        good += [0, 0]
    urls += ["http://new.thin.com/", "http://www.new.spam/", "http://new.site1.com/", "http://www.other.com/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    outcomes = spark.createDataFrame(list(enumerate(good)), "page_id bigint, good int")
    got = {r.host: r.verdict for r in url_reputation.judged(pages, outcomes, []).collect()}
    bad = {"bad.site1.com", "new.thin.com", "www.new.spam"} | {f"h{i}.thin.com" for i in range(60)} | {f"www.d{i}.spam" for i in range(60)}
    assert {h for h, v in got.items() if v == "block"} == bad
