"""Ranked lexical search: impact-ordered postings, score at a time.

One pass over the documents stores, for each of them, its length and the counts of those terms that the items ask for; the
corpus counts come from that table. A second pass reads it in shards of bounded size, each inside one task: a shard's postings
are grouped by term and exact impact, highest impact first. For an item the groups of its terms are processed in descending
order of what they add to a score. After each step the largest additions still to come bound what any document can gain; when
these bounds prove that all of the best k are among a few documents, the rest of the postings is skipped and the scores of the
few are completed from the documents' own terms. What a task has found before bounds its later shards as well. Each task hands
on its best k for each item, so nothing is shuffled but those, and no frequent term gathers anywhere.

All arithmetic is in exact integers, but for the logarithm in the weight of a term, so the ranking is that of a whole
evaluation. The items' terms are sent to the tasks; items are taken in portions of ITEM_BYTES of text, each with a pass of its
own, so what is sent doesn't grow.

Terms are the runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A null or empty text
has none and counts nowhere; texts of any length are read whole. Repeated rows are documents of their own and share places in
the ranking by their ids; rows with a null id are left out. Rows of one item id are one item with the terms of all; items
without terms or with a null id give no rows. Further columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import stored, table

#: Bytes of item texts in one portion.
ITEM_BYTES = 8_000_000
#: Postings and documents of a shard.
POSTINGS, DOCUMENTS = 2_000_000, 50_000
#: The bounds are looked at when this share of an item's postings is done, and again after each doubling.
FIRST_SHARE = 1 / 32
#: Scores are completed for so many documents for each place of the ranking at most.
COMPLETED = 16
#: Parts in which a ranking is merged first.
SALT = 32

#: Bytes of a term as they are (A-Z lower-cased), all others as a space.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def counted(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms and tf of each row of ``docs`` that has a term; ``terms`` are the numbers of asked ones, ascending."""
    numbers = docs.sparkSession.sparkContext.broadcast(asked)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in rows:
            kept, sizes, terms, tf, at = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py() or b"")
                if not words:
                    continue
                count = Counter(words)
                own = sorted((known[t], count[t]) for t in count.keys() & known.keys())
                kept.append(i)
                sizes.append(len(words))
                terms += [t for t, _ in own]
                tf += [n for _, n in own]
                at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact-ordered postings of some documents, and the same postings by document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, begin: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int, known: int):
        self.ids, self.begin, self.terms = ids, begin, terms
        m = 10 + (90 * sizes * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), np.diff(begin))
        tf = tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.doc = doc[order]
        t, i = terms[order], self.impact[order]
        new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])))) if len(t) else np.zeros(0, dtype=np.int64)
        # groups of equal term and impact, and where each term's groups begin
        self.group_begin = np.concatenate((new, [len(t)]))
        self.group_impact = i[new]
        self.first_group = np.searchsorted(t[new], np.arange(known + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (ids and scores) of an item among those that can reach ``floor``; and the postings processed."""
        lo, hi = self.first_group[terms], self.first_group[terms + 1]
        n = hi - lo
        start = np.cumsum(n) - n
        groups = np.repeat(lo - start, n) + np.arange(n.sum())
        of = np.repeat(np.arange(len(terms)), n)
        added = weights[of] * self.group_impact[groups]
        heads = np.concatenate((added, [0]))
        # the next addition of each term; terms without groups have none
        to_come = np.where(n > 0, heads[start], 0)
        if not len(groups) or int(to_come.sum()) < max(floor, 1):
            return self.ids[:0], added[:0], 0
        order = np.argsort(-added, kind="stable")  # keeps each term's groups in their order
        length = self.group_begin[groups + 1] - self.group_begin[groups]
        done_after = np.cumsum(length[order])
        total, done, at, share = int(done_after[-1]), 0, 0, FIRST_SHARE
        score, used = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        while True:
            to = int(np.searchsorted(done_after, max(share * total, done + 1))) + 1 if share < 1 else len(order)
            some = order[at:to]
            sizes = length[some]
            postings = np.repeat(self.group_begin[groups[some]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            np.add.at(score, self.doc[postings], np.repeat(added[some], sizes))
            used += np.bincount(of[some], minlength=len(terms))
            done, at, share = done + len(postings), to, 2 * share
            if at >= len(order):
                few = np.flatnonzero(score >= max(floor, 1))
                return *ranked(self.ids[few], score[few], k), done
            rest = int(np.where(used < n, heads[np.minimum(start + used, len(added))], 0).sum())
            reach = max(floor, int(np.partition(score, -k)[-k]) if len(score) >= k else 0, 1)
            if rest < reach:  # a document without any score yet can't get there
                few = np.flatnonzero(score + rest >= reach)
                if len(few) <= COMPLETED * k:
                    whole = self.completed(few, weight_of)
                    enough = whole >= max(floor, 1)
                    return *ranked(self.ids[few[enough]], whole[enough], k), done

    def completed(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """The whole scores of some documents, from their own terms."""
        sizes = self.begin[docs + 1] - self.begin[docs]
        at = np.repeat(self.begin[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.zeros(len(docs), dtype=np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes), weight_of[self.terms[at]] * self.impact[at])
        return out


def ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cut a task's rows into shards."""
    held, postings, documents = [], 0, 0
    for batch in rows:
        step = max(1, min(len(batch), DOCUMENTS // 10))
        for part in (batch.slice(i, step) for i in range(0, len(batch), step)):
            held.append(part)
            postings += len(part.column(2).flatten())
            documents += len(part)
            if postings >= POSTINGS or documents >= DOCUMENTS:
                yield pa.Table.from_batches(held)
                held, postings, documents = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def found(index: DataFrame, items: list[tuple[int, list[int]]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id and score of the best k documents of each task for each item."""
    sent = index.sparkSession.sparkContext.broadcast((items, np.array(weights, dtype=np.int64)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, all_weights = sent.value
        own = [(np.array([t for t in terms if all_weights[t] > 0], dtype=np.int64)) for _, terms in items]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2] * len(items)
        for part in shards(rows):
            lists = part.column("terms").combine_chunks(), part.column("tf").combine_chunks()
            sizes = np.diff(lists[0].offsets.to_numpy())
            begin = np.concatenate(([0], np.cumsum(sizes)))
            shard = Shard(part.column("doc_id").to_numpy(), part.column("n").to_numpy(), begin, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), n_docs, n_terms, len(all_weights))
            weight_of = np.zeros(len(all_weights), dtype=np.int64)
            for i, terms in enumerate(own):
                ids, scores = best[i]
                weight_of[terms] = all_weights[terms]
                more_ids, more, _ = shard.best(terms, all_weights[terms], weight_of, k, int(scores[-1]) if len(scores) >= k else 0)
                weight_of[terms] = 0
                if len(more):
                    best[i] = ranked(np.concatenate((ids, more_ids)), np.concatenate((scores, more)), k)
        for lo in range(0, len(items), 10_000):
            some = range(lo, min(lo + 10_000, len(items)))
            columns = [[items[i][0] for i in some for _ in best[i][0]], [x for i in some for x in best[i][0].tolist()], [x for i in some for x in best[i][1].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def searched(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: the best k rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = max(1, math.ceil(size / ITEM_BYTES))
    results = []
    for portion in range(portions):
        texts: dict[int, set[bytes]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == portion).collect():  # a portion of bounded size
            texts.setdefault(r["item_id"], set()).update(terms_of(bytes(r["text"] or b"")))
        asked = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
        index = stored(counted(docs, asked))
        about = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        # one row for each asked term
        df = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = [weight(about["n"], df.get(i, 0)) for i in range(len(asked))]
        results.append(found(index, [(i, sorted(asked[t] for t in terms)) for i, terms in sorted(texts.items())], weights, about["n"], about["l"] or 1, k))
    best = results[0]
    for more in results[1:]:
        best = best.union(more)
    order = [F.desc("score"), F.asc("doc_id")]
    best = best.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))).where(F.col("_n") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
c AS MATERIALIZED (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT term, floor(1000::DOUBLE * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term),
i AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS added FROM p JOIN f USING (term), c),
s AS (SELECT item_id, r, doc_id, sum(added)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
WHERE rank <= 10
"""
