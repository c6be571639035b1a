"""MinHash near-dedup with SuperMinHash signatures: banding, verification on full sets, union-find grouping.

Every shingle of a document gets a random permutation of the signature's places, and in its j-th place the value j + a
random fraction; a place keeps its least value. As later places have larger values, a document stops as soon as all
places are filled. The ranks of one shingle are correlated, which lowers the variance of the estimate.

Documents with equal shingle sets are one class, of which the smallest id stands for all. Classes that share a band are
compared with the smallest of the band first, and groups are formed. Of a band whose classes are still in different
groups, the largest group stays as it is; the classes outside of it are compared with all classes of the band by
signature, and those whose estimate doesn't rule a link out are clustered; within a cluster the classes outside of its
largest group are compared with all others on their full sets. Both comparisons run in blocks, one task for each pair of
a block of outsiders and a block of members, so a large group costs a member one copy for each block of its outsiders.
A block returns only links that join groups, so no link that could join two groups is left out, and no list of all pairs
of a large group arises.

Texts are lower-cased (A-Z); words are the runs of other bytes than ASCII white space; a text with fewer words than a
shingle has one shingle, an empty or null text none, and no link. Rows with a null id are left out. Rows that share an
id count as linked, those of an empty text too. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BASE, Words, batches, components, cut, mix64, table

#: Bands and rows in a band: two sets of likeness 0.8 miss all bands with a chance of (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
#: Under this share of equal places (4.5 standard deviations under 0.8) two sets are not compared; chance 3e-6.
DOUBT = 0.64
#: Rows of a block in comparisons, and bytes of text of a block in comparisons by full sets.
BLOCK, BLOCK_BYTES = 1024, 2_000_000
#: Nodes that a task's union-find holds before it starts afresh.
FOREST = 500_000
#: Bytes of text that are hashed at once.
PIECE = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, one after the other, and where each text's begin (and the end)."""
    w = Words(texts, lower=True)
    count = np.diff(w.first)
    own = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), own)
    at = np.arange(len(doc)) - (np.cumsum(own) - own)[doc] + w.first[:-1][doc]
    values = w.grams(k)[at]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        where = np.searchsorted(doc, few)
        whole = [0] * len(few)
        for j, d in enumerate(few.tolist()):
            h = 0
            for x in w.hash[w.first[d] : w.first[d + 1]].tolist():
                h = (h * int(BASE) + x) % (1 << 64)
            whole[j] = h
        values[where] = mix64(np.array(whole, dtype=np.uint64) + count[few].astype(np.uint64))
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (values[1:] != values[:-1]))) if len(doc) else np.zeros(0, dtype=bool)
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(len(texts) + 1))


def super_minhash(values: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size) of the sets: in the high half of each value the rank, in the low half the fraction."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    out = np.full((n, size), EMPTY, dtype=np.uint64)
    flat, place = out.reshape(-1), None
    for j in range(size):
        draw = mix64(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        if j:
            rows = np.arange(len(values))
            slot = place[rows, pick].astype(np.int64)
            place[rows, pick] = place[:, j]
        else:
            slot = pick
        np.minimum.at(flat, doc * size + slot, np.uint64(j << 32) | (draw >> np.uint64(32)))
        open_docs = (out == EMPTY).any(axis=1)
        live = open_docs[doc]
        if not live.any():
            break
        values, doc = values[live], doc[live]
        if j:
            place = place[live] if not live.all() else place
        else:
            place = np.tile(np.arange(size, dtype=np.uint8), (len(values), 1))
            place[np.arange(len(values)), slot[live]] = 0
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for i in range(ROWS):
        key = mix64(key * BASE + parts[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, bytes of text, d1, d2 (a digest of the set), the band keys and the signature (a byte a place) of
    each row of ``docs`` (doc_id, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            for b, e in batches(texts, PIECE):
                values, begin = shingles(texts[b:e], k)
                sizes = np.diff(begin)
                digests = []
                for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values ^ salt))))
                    digests.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
                signatures = super_minhash(values, begin, BANDS * ROWS)
                keys = band_keys(signatures)
                short = signatures.astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (e - b) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, e - b), pa.array(sizes.astype(np.int64)), pa.array(list(map(len, texts[b:e])), pa.int64()), *map(pa.array, digests), lists, pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "n_shingles", "bytes", "d1", "d2", "bands", "sig"])

    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, bytes bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are alike enough, as many as join the groups that a task sees."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in rows:
            union = Union() if len(union.up) > FOREST else union
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for lo in range(0, len(a), 256):
                some = batch.slice(lo, 256)
                texts = [t.as_py() or b"" for c in ("text_a", "text_b") for t in some.column(c)]
                number: dict[bytes, int] = {}
                which = [number.setdefault(t, len(number)) for t in texts]
                distinct, sets = list(number), []
                for i, j in batches(distinct, PIECE):
                    values, begin = shingles(distinct[i:j], k)
                    sets += np.split(values, begin[1:-1])
                n, good = len(some), []
                for i in range(n):
                    if alike(sets[which[i]], sets[which[n + i]], percent) and union.join(a[lo + i], b[lo + i]):
                        good.append(lo + i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text"))
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows (key, rep, c, bytes, ...) out so that each class outside of its key's largest group c meets every class
    of the key: adds i and j (blocks of outsiders and of members), probe and outside."""
    sums = rows.groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    largest = F.max_by(F.struct("c", "n", "b"), F.struct("n", "c"))
    sums = sums.groupBy(key).agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), largest.alias("_top"))
    count = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    sums = sums.select(key, F.col("_top.c").alias("_c"), count(F.col("_n"), F.col("_b")).alias("_j"), count(F.col("_n") - F.col("_top.n"), F.col("_b") - F.col("_top.b")).alias("_i"))
    rows = rows.join(sums, key).withColumn("outside", F.col("c") != F.col("_c"))
    own, every = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = F.transform(every("_i"), lambda i: F.struct(i.alias("i"), own("_j").alias("j"), F.lit(False).alias("probe")))
    probe = F.transform(every("_j"), lambda j: F.struct(own("_i").alias("i"), j.alias("j"), F.lit(True).alias("probe")))
    places = F.explode(F.when(F.col("outside"), F.concat(member, probe)).otherwise(member))
    return rows.withColumn("_at", places).drop("_c", "_i", "_j", "bytes").select("*", "_at.*").drop("_at")


def pairs_of_blocks(rows: DataFrame, key: str):
    """Group by pairs of blocks. A join may have dealt the rows by the key alone; a large one is to be spread over tasks."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key, "i", "j").groupBy(key, "i", "j")


def doubtful(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an outsider and a member in different groups whose signatures don't rule a link out, best first."""
    probe, outside = rows.column("probe").to_numpy(zero_copy_only=False), rows.column("outside").to_numpy(zero_copy_only=False)
    c, rep = rows.column("c").to_numpy(), rows.column("rep").to_numpy()
    first, second = np.flatnonzero(probe), np.flatnonzero(~probe)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
    out = [np.zeros((3, 0), dtype=np.int64)]
    columns = np.ascontiguousarray(sig[second].T)
    for x in first.tolist():
        equal = np.zeros(len(second), dtype=np.uint8)
        for place, value in zip(columns, sig[x].tolist(), strict=True):
            equal += place == value
        # two outsiders meet twice
        j = np.flatnonzero((equal >= DOUBT * sig.shape[1]) & (c[second] != c[x]) & (~outside[second] | (rep[second] > rep[x])))
        out.append(np.stack((np.full(len(j), x), second[j], equal[j])))
    a, b, equal = np.concatenate(out, axis=1)
    best = np.argsort(-equal, kind="stable")
    return a[best], b[best]


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def doubts(rows: pa.Table) -> pa.Table:
    """A forest that spans the doubtful pairs of two blocks."""
    rep, union = rows.column("rep").to_pylist(), Union()
    a, b = doubtful(rows)
    kept = [(rep[i], rep[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if union.join(rep[i], rep[j])]
    return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough, by exact counts."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def settled(k: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """Links that join groups of two blocks, by full sets."""
        rep, c, texts = rows.column("rep").to_pylist(), rows.column("c").to_pylist(), [t.as_py() or b"" for t in rows.column("text")]
        a, b = doubtful(rows)
        union, sets, kept = Union(), [], []
        for lo, hi in batches(texts, PIECE) if len(a) else ():
            values, begin = shingles(texts[lo:hi], k)
            sets += np.split(values, begin[1:-1])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if union.root(c[i]) != union.root(c[j]) and alike(sets[i], sets[j], percent):
                union.join(c[i], c[j])
                kept.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    return run


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group) and kept for each row of ``docs`` (doc_id, text)."""
    sets = cut(signed(docs, k))
    classes = sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min_by(F.struct("bands", "sig", "bytes"), "doc_id").alias("s"))
    classes = cut(classes)
    bands = classes.select("rep", "n", F.explode("s.bands").alias("key"))
    often = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("first")).where("m > 1").select("key", "first")
    shared = cut(bands.join(often, "key"))
    near = F.expr(f"100 * least(n, n0) >= {percent} * greatest(n, n0)")
    sizes = shared.where("rep = first").select(F.col("key"), F.col("n").alias("n0"))
    first = shared.where("rep <> first").join(sizes, "key").where(near).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(verified(first, docs, k, percent))
    # what shares a band but not a group yet
    member = shared.select("key", "rep").join(groups.withColumnsRenamed({"node": "rep"}), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    apart = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    signatures = classes.select("rep", "s.sig")
    open_bands = member.join(apart, "key", "left_semi").withColumn("bytes", F.lit(0))
    forest = pairs_of_blocks(in_blocks(open_bands, "key").join(signatures, "rep"), "key").applyInArrow(doubts, "a bigint, b bigint")
    clusters = components(forest).withColumnsRenamed({"node": "rep", "component": "cluster"})
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("binary").alias("text"))
    groups_of = clusters.join(groups.withColumnsRenamed({"node": "rep"}), "rep", "left").select("cluster", "rep", F.coalesce("component", "rep").alias("c"))
    sized = groups_of.join(classes.select("rep", "s.bytes"), "rep")
    whole = in_blocks(sized, "cluster").join(signatures, "rep").join(texts, "rep")
    late = pairs_of_blocks(whole, "cluster").applyInArrow(settled(k, percent), "a bigint, b bigint")
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late)
    # an id is a node, so the classes of an id's rows are linked through it
    repeated = sets.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = sets.where("n_shingles > 0").select("doc_id", "d1", "d2").join(repeated, "doc_id", "left_semi")
    groups = components(links.union(several.join(classes, ["d1", "d2"]).where("doc_id <> rep").select("doc_id", "rep").distinct()))
    group = F.coalesce("component", "rep")
    joined = sets.join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    joined = joined.join(groups.withColumnsRenamed({"node": "rep"}), "rep", "left")
    return joined.select("doc_id", "n_shingles", group.alias("component_id"), (F.col("doc_id") == group).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, by 4-word shingles."""
    return grouped(table(spark, sf_dir, "documents"), k=4, percent=80)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document (the smallest id) of each near-duplicate group, by 5-word shingles."""
    kept = grouped(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id") == F.col("_kept_id"), "left_semi")
    # of rows that share an id (they count as linked) the one with the least text stays, of those the least by its other columns
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name != "text"]
    least = F.struct(F.coalesce("text", F.lit("")), F.col("text").isNull(), F.struct(*plain))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), least).alias("r"))
    return one.select(*[F.col(f"r.`{c}`") for c in docs.columns])
