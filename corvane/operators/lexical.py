"""A stored index for lexical search: postings by scope, version and term bucket, refreshed scope by scope.

    index = lexical.Index(spark, path)
    index.refresh(docs)                      # docs hold all documents of the scopes that they name
    index.bm25(queries, "item_id")           # as retrieval.bm25 over all documents of all scopes

``postings/scope=S/version=V/bucket=B`` holds lists of postings (term, and arrays of doc_id, dl and tf), sorted by term in each file.
Documents are dealt by scope and id, and a task makes a list of a term for each block of its documents and writes it where it is, so
that postings are neither shuffled nor sorted as rows. V is a digest of a scope's documents, so a batch that comes again finds its
version in place and changes nothing. A refresh writes the new versions first, then publishes a
manifest (scope, version, n_docs, sum_dl; a row for each scope) as a new folder, and deletes replaced versions at last: a failure
before the publication leaves the index as it was, one after it leaves only what the next refresh deletes. Corpus-wide counts come
from the manifest and from the postings of all live versions, so a refresh of one scope gives the scores of a rebuild.

A search reads the buckets of the asked terms only (partition filters). A frequent term's postings lie in as many files as its
scope's texts were dealt to.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.stems import stemmed
from corvane.functions.text import tokens
from corvane.operators.retrieval import B, K1, MOST_TERMS, best_scored, by_document, numbered, stems_of
from corvane.sources import store

#: Characters of a scope that are dealt to one task, about; asked terms that are named in the scan's filter at most.
PART, NAMED = 16_000_000, 1000
#: Tokens of a block of documents whose lists are made at once, about; postings of one list at most.
BLOCK_TOKENS, LIST = 2_000_000, 65_536
#: The form of the stored lists; an index of another form is written anew.
FORM = "lists 1"


def scope_key(scope: Column) -> Column:
    """A scope as a folder's name; null is a scope of its own."""
    return F.when(scope.isNull(), "none").otherwise(F.concat(F.lit("of "), scope.cast("string")))


def lists_of(rows: pa.Table, buckets: int, most: int) -> pa.RecordBatch:
    """Documents (scope, doc_id, words) as lists (scope, term, doc_id, dl, tf) of at most ``most`` postings, by scope, bucket and term. The
    empty term stands once in each document: its postings are the documents. Rows of one id and length are one document."""
    scope, ids = rows.column("scope").combine_chunks().dictionary_encode(), rows.column("doc_id").combine_chunks()
    words = rows.column("words").combine_chunks()
    size = np.diff(words.offsets.to_numpy()).astype(np.int64)
    in_order = ids.dictionary_encode(null_encoding="encode")
    key = (scope.indices.to_numpy().astype(np.int64) * len(in_order.dictionary) + in_order.indices.to_numpy()) * (size.max() + 1) + size
    _, first, doc = np.unique(key, return_index=True, return_inverse=True)
    own = scope.indices.to_numpy()[first].astype(np.int64)
    coded = words.flatten().dictionary_encode()
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""], pa.string())])
    bucket = np.array([zlib.crc32(t.encode()) % buckets for t in terms.to_pylist()])
    order = pc.sort_indices(terms).to_numpy()
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # a posting is a number: scope, term, document
    term = place[np.r_[coded.indices.to_numpy(), np.full(len(rows), len(terms) - 1)]]
    doc = np.r_[np.repeat(doc, size), doc]
    posting, tf = np.unique((own[doc] * len(terms) + term) * len(first) + doc, return_counts=True)
    listed, doc = np.divmod(posting, len(first))
    start = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]])
    # long lists go on as others
    start = np.flatnonzero((np.arange(len(listed)) - np.repeat(start, np.diff(np.r_[start, len(listed)]))) % most == 0)
    ends = pa.array(np.r_[start, len(listed)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(first[doc])), pa.array(size[first][doc].astype(np.int32)), pa.array(tf.astype(np.int32)))]
    at, term = np.divmod(listed[start], len(terms))
    return pa.RecordBatch.from_arrays([scope.dictionary.take(pa.array(at)).cast(pa.string()), terms.take(pa.array(order[term])), *lists], ["scope", "term", "doc_id", "dl", "tf"])


def listed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of postings of documents that come by scope and id, made in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            # a batch may hold many long texts
            sizes = np.cumsum(np.diff(batch.column("words").offsets.to_numpy()) + 1)
            cuts = np.unique(np.searchsorted(sizes, np.arange(BLOCK_TOKENS, sizes[-1] if len(sizes) else 0, BLOCK_TOKENS)))
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                held.append(batch.slice(lo, hi - lo))
                n += int(sizes[hi - 1] - (sizes[lo - 1] if lo else 0)) if hi > lo else 0
                if n < BLOCK_TOKENS:
                    continue
                rows = pa.Table.from_batches(held)
                code = lambda c: rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()  # noqa: B023, E731
                scope, ids = code("scope"), code("doc_id")
                other = np.flatnonzero((scope != scope[-1]) | (ids != ids[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last id may come again
                if cut:
                    yield lists_of(rows.slice(0, cut), buckets, LIST)
                held, n = rows.slice(cut).combine_chunks().to_batches(), 0
        if sum(map(len, held)):
            yield lists_of(pa.Table.from_batches(held), buckets, LIST)

    return run


class Index:
    """The index in one folder. ``buckets`` and ``stem`` (a language of ``stems``) are fixed when it is first filled."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, stem: str | None = None):
        self.spark, self.path, self.stem = spark, path, stem
        self.buckets = buckets

    def _manifests(self) -> list[int]:
        """Numbers of the published manifests, newest last."""
        files, where = store.at(self.spark, f"{self.path}/manifest")
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        found = [int(m[1]) for m in (re.fullmatch(r"n(\d+)", n) for n in names) if m]
        return sorted(n for n in found if store.exists(self.spark, f"{self.path}/manifest/n{n}/_SUCCESS"))

    def live(self) -> dict[str, tuple[str, int, int]]:
        """The published scopes: version, number of documents, sum of their lengths."""
        known = self._manifests()
        if not known:
            return {}
        return {r["scope"]: (r["version"], r["n_docs"], r["sum_dl"]) for r in self.spark.read.parquet(f"{self.path}/manifest/n{known[-1]}").collect()}

    def _term_bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")  # as in ``lists_of``

    def refresh(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope", gone: list | None = None) -> list[str]:
        """Replace the scopes that ``docs`` holds (whole) and drop those named by ``gone``; returns the scopes that changed."""
        before = self.live()
        rows = docs.select(scope_key(F.col(scope)).alias("scope"), F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        digest = F.sha1(F.concat_ws(" ", F.lit(f"{FORM} {self.buckets} {self.stem}"), F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64("text", "doc_id", F.lit(1)).cast("decimal(38,0)")).cast("string")))
        found = rows.groupBy("scope").agg(digest.alias("version"), F.sum(F.length("text")).alias("size")).collect()  # a row for each scope
        new = {r["scope"]: r["version"] for r in found}
        self._sizes = {r["scope"]: r["size"] for r in found}
        changed = {s: v for s, v in new.items() if s not in before or before[s][0] != v}
        dropped = [s for s in ("none" if g is None else f"of {g}" for g in gone or []) if s in before and s not in new]
        counts = self._write(rows, changed) if changed else {}
        if changed or dropped:
            after = {s: x for s, x in before.items() if s not in changed and s not in dropped} | {s: (v, *counts[s]) for s, v in changed.items()}
            n = max(self._manifests(), default=0) + 1
            manifest = self.spark.createDataFrame([(s, *x) for s, x in sorted(after.items())], "scope string, version string, n_docs bigint, sum_dl bigint")
            manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/n{n}")
            self._vacuum()
        return sorted([*changed, *dropped])

    def _write(self, rows: DataFrame, versions: dict[str, str]) -> dict[str, tuple[int, int]]:
        """Write the postings of some scopes; returns their numbers of documents and sums of lengths."""
        parts = lambda s: max(1, round(self._sizes[s] / PART))
        named = F.broadcast(self.spark.createDataFrame([(s, v, parts(s)) for s, v in sorted(versions.items())], "scope string, version string, parts int"))
        # texts are dealt by scope and document, so that lists are made where texts are cut; a version is named again when it is written
        docs = rows.join(named, "scope").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        # parts meet by chance in a task, so there are more tasks than parts, however long the texts
        tasks = 2 * sum(map(parts, versions))
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        docs = (docs.repartition(tasks, "scope", "_part") if tasks > usual else docs.repartition("scope", "_part")).sortWithinPartitions("scope", "doc_id")
        lists = docs.select("scope", "doc_id", tokens(F.col("text")).alias("words")).mapInArrow(listed(self.buckets), "scope string, term string, doc_id array<bigint>, dl array<int>, tf array<int>")
        if self.stem:  # words of one stem keep lists of their own
            lists = lists.withColumnRenamed("term", "_word").join(stems_of(lists, self.stem), "_word").drop("_word")
            lists = lists.repartition("scope", self._term_bucket(F.col("term")))
        dealt = lists.join(named.drop("parts"), "scope").withColumn("bucket", self._term_bucket(F.col("term"))).sortWithinPartitions("scope", "version", "bucket", "term")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "version", "bucket").parquet(f"{self.path}/postings")
        stats = self._postings().where(F.col("version").isin(sorted(versions.values())) & (F.col("bucket") == self._number("")) & (F.col("term") == ""))
        total = F.aggregate("dl", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return {r["scope"]: (r["n"], r["s"]) for r in stats.groupBy("scope").agg(F.sum(F.size("doc_id")).alias("n"), F.sum(total).alias("s")).collect()}

    def _number(self, term: str) -> int:
        return self.spark.range(1).select(self._term_bucket(F.lit(term))).first()[0]

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("term string, doc_id array<bigint>, dl array<int>, tf array<int>, scope string, version string, bucket int").parquet(f"{self.path}/postings")

    def _vacuum(self) -> None:
        """Delete versions that no manifest but the newest names, and old manifests."""
        live = {s: x[0] for s, x in self.live().items()}
        files, where = store.at(self.spark, f"{self.path}/postings")
        for folder in files.listStatus(where) if files.exists(where) else []:
            if not folder.getPath().getName().startswith("scope="):
                continue
            for version in files.listStatus(folder.getPath()):
                if version.getPath().getName().removeprefix("version=") not in live.values():
                    files.delete(version.getPath(), True)
        for n in self._manifests()[:-1]:
            store.delete(self.spark, f"{self.path}/manifest/n{n}")

    def bm25(self, queries: DataFrame, query_id: str, text: str = "text", keep: DataFrame | None = None, best: int | None = None, digits: int = 6, groups: DataFrame | None = None) -> DataFrame:
        """BM25 scores: query id, doc_id, score. ``keep`` (doc_id) restricts the documents, not the corpus' counts.

        ``best`` and ``digits`` are those of ``retrieval.bm25``; with ``groups`` (doc_id, g: one int for each document) what can be among
        the best of each group is returned.
        """
        live = self.live()
        asked = queries.select(F.col(query_id), F.explode(tokens(F.col(text))).alias("term"))
        if self.stem:
            asked = asked.withColumn("term", stemmed(F.col("term"), self.stem))
        asked = asked.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
        n_docs, sum_dl = sum(x[1] for x in live.values()), sum(x[2] for x in live.values())
        few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
        small = F.broadcast if few else lambda df: df
        if not n_docs:
            return asked.select(query_id, F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
        rows = self._postings().where(F.col("version").isin(sorted(x[0] for x in live.values())))
        # at most one number for each bucket, and the terms themselves while they are few
        terms = asked.select("term", self._term_bucket(F.col("term")).alias("bucket")).distinct()
        rows = rows.where(F.col("bucket").isin([r[0] for r in terms.select("bucket").distinct().collect()]) & (F.col("term") != ""))
        if len(named := [r[0] for r in terms.select("term").limit(NAMED + 1).collect()]) <= NAMED:
            rows = rows.where(F.col("term").isin(named))
        lists = rows.join(small(asked.select("term").distinct()), "term", "left_semi")
        found = lists.select("term", F.inline(F.arrays_zip("doc_id", "dl", "tf")))
        if self.stem:
            found = found.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
            df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:
            df = lists.groupBy("term").agg(F.sum(F.size("doc_id")).alias("df"))
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(sum_dl / n_docs)))
        if keep is not None:
            found = found.join(keep.select(F.col("doc_id")).distinct(), "doc_id", "left_semi")
        if best and few:
            of_terms, of_queries, pairs = numbered(asked, query_id)
            weights = found.join(F.broadcast(df.select("term", idf.alias("idf")).join(F.broadcast(of_terms), "term")), "term").select("doc_id", "t", (weight * F.col("idf")).alias("w"))
            if groups is not None:  # a document's group comes as a row of its own, as a join behind the shuffle may part its rows
                weights = weights.unionByName(groups.select("doc_id", F.lit(-1).alias("t"), F.col("g").cast("double").alias("w")))
            return best_scored(by_document(weights, "doc_id", n_docs, queries.count()), pairs, of_queries, "doc_id", query_id, best, digits)
        found = by_document(found, "doc_id", n_docs, queries.count())  # postings are fewer than the pairs that they score
        scored = found.join(small(asked.join(df.select("term", idf.alias("idf")), "term")), "term")
        scored = scored.groupBy(query_id, "doc_id").agg(F.sum(weight * F.col("idf") * F.col("qtf")).alias("score"))
        return scored.withColumn("score", F.round("score", digits)) if best else scored


def of_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope") -> Index:
    """The index of a stored table in the shared folder: filled at the first call for its files, found by later ones."""
    spark, names = docs.sparkSession, docs.inputFiles()
    stamp = []
    for name in sorted(names):
        files, where = store.at(spark, name)
        status = files.getFileStatus(where)
        stamp.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    digest = spark.range(1).select(F.sha1(F.lit("\n".join([*stamp, doc_id, text, scope, FORM])))).first()[0]
    index = Index(spark, f"{store.shared_folder(spark)}/lexical-{digest}")
    if not index.live():
        index.refresh(docs, doc_id, text, scope)
    return index
