"""The pipeline on a small fixture: each stage beside its plain version, and the whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import mixing
from tests.llm import brute
from tests.llm.test_edges import sentences

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, slot int, position int, y int, _row string, n_bytes int, n_removed int, bucket int, more string, rep int, accepted string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, exact and near copies, shared passages, null and empty texts, equal ids, clashing columns."""
    rng = random.Random(21)
    docs, labels = [], []
    passage = sentences(rng, 60)
    for i in range(360):
        good = i % 4 > 0
        text = sentences(rng, 40) if good else " ".join(rng.choice(["!!#", "$$", "a1", "%%"]) for _ in range(40))
        if good and i % 10 == 1:
            text += " " + passage + " " + sentences(rng, 20)
        if good and i % 12 == 5:
            text = docs[-4][1] if docs[-4][1] else text
        if good and i % 12 == 7:
            text = sentences(rng, 150)
            docs.append((1000 + i, text.replace(text.split()[3], "other", 1), "en", "s1", len(text)))
        docs.append((i, text, "en" if good else "xx", f"s{min(int(rng.expovariate(0.5)), 4)}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
        elif i % 4 == 0:
            labels.append((i, 0, 0))
    docs += [(2000, None, "en", "s0", None), (2001, "", "en", None, 0), (2002, "", None, "s0", 0), (7, docs[7][1], "en", "s2", 5)]
    rows = [(*d, 0.5, 1, 2, 3, "x", 4, 5, 6, "m", 7, "a") for d in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_whole(spark, folder):
    from corvane.llm.common import stored

    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, folder))
        seen[name] = docs.collect()
        had = before.collect()
        if name == "bpe":
            break
        assert set(before.columns) <= set(docs.columns)
        kept = {r.doc_id: r for r in seen[name]}
        if name == "quality":
            # without words there is nothing to tell good from bad by, so ids from 2000 on may go
            assert {r.doc_id for r in had if r.doc_id < 2000} - set(kept) == {i for i in range(360) if i % 4 == 0}
            assert {tuple(r) for r in seen[name]} <= {tuple(r) for r in had}
        if name == "minhash":
            groups = brute.near_dups([(r.doc_id, r.text) for r in had if r.doc_id != 7 or r.n_chars != 5], k=5)
            assert sorted(r.doc_id for r in seen[name]) == sorted(d for d, (_, _, keep) in groups.items() if keep)
            assert {tuple(r) for r in seen[name]} <= {tuple(r) for r in had}
        if name == "suffix":
            left = brute.suffix_dedup([(r.doc_id, r.text) for r in had])
            assert set(kept) == {d for d, (n, gone, _, _) in left.items() if gone < n or n == 0}
            for d, r in kept.items():
                assert brute.sha((r.text or "").encode()) == left[d][3] and (r.n_chars == len(r.text or "") or r.text is None)
        if name == "mixing":
            place = {r.doc_id: r.position for r in mixing.mixed(before.select("doc_id", "source")).collect()}
            assert {r.doc_id: r[mixing.PLACE] for r in seen[name]} == place and len(place) == len(had)
            assert {tuple(r)[:-1] for r in seen[name]} == {tuple(r) for r in had}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen["bpe"]))
    assert {r.doc_id: r.position for r in whole} == {r.doc_id: r[mixing.PLACE] for r in seen["mixing"]}
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    for r in whole:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(b"".join(i.to_bytes(4, "little") for i in ids))


def test_empty_tables_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count(F.lit(1))).first()[0] == 0
