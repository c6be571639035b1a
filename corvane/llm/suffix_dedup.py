"""Suffix-array dedup: remove every byte that a 100-byte string covers which also starts earlier in the corpus.

Texts are UTF-8 bytes. The suffixes that matter, those at anchors that repeat (see ``repeats``), are sorted in runs by
their first 100 bytes, front-coded (each suffix without the prefix it shares with the one before) and exchanged by
range. Loser trees merge the runs; every head knows its common prefix with the last suffix put out, so known prefixes
are never compared again, and the merged order comes with its common-prefix lengths. A 100-byte string around an anchor is
the last s bytes before it and 100 - s bytes from it on. Suffixes with the same 100 - s bytes are a stretch of the merged
order in which no common-prefix length is less; in the same way the bytes before the anchors, read backwards and sorted
once, give stretches with the same s bytes. What shares both stretches shares the string, and all but the earliest of
these go.

"Earlier" is the order of (doc_id, start). Null texts count as empty; texts under 100 bytes lose nothing. Rows with a
null id are left out. Repeated rows each give a row; the second of two equal rows counts as later. Further columns are
kept, whatever their names; those with the name of a new column are replaced. An empty table gives an empty result.

What one task holds: a bucket of texts, or one range of the merge. A context that many texts share is one record of each
bucket. The strings around an anchor with more than ``repeats.HOT`` occurrences are spread over all ranges by digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import repeats
from corvane.llm.common import BASE, BYTE_VALUES, INVERSE, mix64, powers, table

#: Length of the strings in bytes, and of the grams whose hashes choose the anchors.
LENGTH, GRAM = 100, 48
LEFT = LENGTH - GRAM
#: Texts from which the range borders are drawn, at most about so many; bytes of a border.
BORDER_TEXTS, BORDER = 4000, 24

RUNS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("spans", pa.binary()), ("lcps", pa.binary()), ("sizes", pa.binary()), ("tails", pa.binary()), ("left_sizes", pa.binary()), ("lefts", pa.binary()), ("ids", pa.binary()), ("offsets", pa.binary()), ("hot", pa.binary()), ("hot_ids", pa.binary()), ("hot_offsets", pa.binary())])
RUNS_SQL = "part int, bucket int, spans binary, lcps binary, sizes binary, tails binary, left_sizes binary, lefts binary, ids binary, offsets binary, hot binary, hot_ids binary, hot_offsets binary"


def find_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (in the texts laid end to end) and gram hashes of all anchors."""
    offsets, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    done = at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= repeats.PIECE):
            some.append(texts[at])
            size += len(texts[at])
            at += 1
        raw = np.frombuffer(b"".join(some), dtype=np.uint8)
        prefix = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[raw] * powers(BASE, size), out=prefix[1:])
        if size >= GRAM:
            grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * powers(INVERSE, size - GRAM + 1))
            length = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            place = repeats.winnowed(grams, np.cumsum(length) - length, length, GRAM, LENGTH)
            offsets.append(place + done)
            hashes.append(grams[place])
        done += size
    return np.concatenate(offsets), np.concatenate(hashes)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n if not x else n - (x.bit_length() + 7) // 8


def front_coded(sorted_texts: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common-prefix lengths, lengths and the rest of each text."""
    before, lcps, tails = b"", bytearray(), []
    for t in sorted_texts:
        k = common(before, t)
        lcps.append(k)
        tails.append(t[k:])
        before = t
    return bytes(lcps), bytes(map(len, sorted_texts)), b"".join(tails)


def front_decoded(lcps: bytes, sizes: bytes, tails: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(lcps, sizes, strict=True):
        before = before[:k] + tails[at : at + n - k]
        at += n - k
        out.append(before)
    return out


def merged(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (texts, common-prefix lengths): run, index in it, common prefix with the text put out before.

    A loser tree: each inner node holds the loser of its match and the loser's common prefix with the winner. When the
    winner is put out, its run's next text has its own known common prefix with it, and so have all losers on the way
    up; the longer one wins without a look at the texts, and equal ones are compared behind it.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - len(runs))
    at = [0] * width
    lcp = [0 if h is not None else -1 for h in heads]
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = heads[a], heads[b]
        k = common(s, t, x)
        if len(s) == k or (len(t) != k and s[k] < t[k]):
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    winner = list(range(width)) if width == 1 else [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1] if width > 1 else 0
    while heads[top] is not None:
        yield top, at[top], lcp[top]
        texts, known = runs[top]
        i = at[top] = at[top] + 1
        if i < len(texts):
            heads[top], lcp[top] = texts[i], known[i]
        else:
            heads[top], lcp[top] = None, -1
        node = (top + width) >> 1
        while node:
            other = loser[node]
            x, y = lcp[top], lcp[other]
            if y > x:
                loser[node], top = top, other
            elif x == y:
                top, loser[node] = play(top, other)
            node >>= 1


def contexts(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table, borders: list[bytes], ranges: int) -> pa.Table:
    """Sorted front-coded runs of a bucket's contexts; equal contexts are one record, the later ones are covered. Of hot
    anchors the digests of the strings around them."""
    bucket = repeats.Bucket(rows)
    offsets, firsts = repeats.offsets_of(anchors)
    out: dict[int, dict] = defaultdict(dict)  # one row for each range
    if len(offsets):
        data = b"".join(bucket.texts)
        length = np.fromiter(map(len, bucket.texts), dtype=np.int64, count=len(bucket.texts))
        begin = np.cumsum(length) - length
        text_of = np.searchsorted(begin, offsets, side="right") - 1
        first_id = np.fromiter((i[0][0] for i in bucket.ids), dtype=np.int64, count=len(bucket.ids))[text_of]
        order = np.lexsort((offsets, first_id))
        lo = np.maximum(begin[text_of], offsets - LEFT)
        hi = np.minimum(begin[text_of] + length[text_of], offsets + LENGTH)
        seen: dict[bytes, int] = {}
        starts, stops = [], []
        for i, a, b, c in zip(order.tolist(), lo[order].tolist(), offsets[order].tolist(), hi[order].tolist(), strict=True):
            # the place of the anchor in the context is a part of the key
            if seen.setdefault(data[a:c] + bytes((b - a,)), i) != i:
                starts.append(a)
                stops.append(c)
        hot_grams, calm = {data[o : o + GRAM] for o in firsts.tolist()}, []
        places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)  # two anchors may have a string in common
        for i in seen.values():
            at = int(offsets[i])
            if data[at : at + GRAM] not in hot_grams:
                calm.append(i)
                continue
            for place in range(int(lo[i]), min(at, int(hi[i]) - LENGTH) + 1):
                places[repeats.passage_digest(data[place : place + LENGTH])].add((int(first_id[i]), place))
        hot = {digest: min(at) for digest, at in places.items()}
        again = [place for digest, at in places.items() for where in at if (place := where[1]) != hot[digest][1]]
        starts += again
        stops += [place + LENGTH for place in again]
        if starts:
            out[key[0].as_py() % ranges]["spans"] = repeats.spans_packed(starts, stops)
        for part, digests, ids, at in repeats.hot_rows(hot, ranges):
            out[part] |= {"hot": digests, "hot_ids": ids, "hot_offsets": at}
        texts = sorted((data[offsets[i] : hi[i]], data[lo[i] : offsets[i]], i) for i in calm)
        parts = [bisect_right(borders, t[0][:BORDER]) for t in texts]
        edges = [0, *(j for j in range(1, len(parts)) if parts[j] != parts[j - 1]), len(parts)] if parts else []
        for b, e in zip(edges, edges[1:], strict=False):
            some = texts[b:e]
            at = np.array([t[2] for t in some])
            coded = zip(("lcps", "sizes", "tails"), front_coded([t[0] for t in some]), strict=True)
            out[parts[b]] |= dict(coded) | {"left_sizes": bytes(len(t[1]) for t in some), "lefts": b"".join(t[1] for t in some), "ids": first_id[at].tobytes(), "offsets": offsets[at].astype(np.uint32).tobytes()}
    rows_out = [{"part": part, "bucket": key[0].as_py()} | row for part, row in out.items()]
    return pa.Table.from_pylist(rows_out, schema=RUNS)


def merge(group: pa.Table) -> pa.Table:
    """Merge the runs of one range and find what starts earlier elsewhere: bucket, spans."""
    passed, runs, buckets, lefts, ids, offsets = [], [], [], [], [], []
    hot: tuple[list, list, list, list] = ([], [], [], [])
    for r in group.to_pylist():
        if r["spans"] is not None:
            passed.append((r["bucket"], r["spans"]))
        if r["hot"] is not None:
            for column, value in zip(hot, (r["hot"], r["hot_ids"], r["hot_offsets"], [r["bucket"]] * (len(r["hot"]) // 16)), strict=True):
                column.append(value)
        if r["lcps"] is not None:
            runs.append((front_decoded(r["lcps"], r["sizes"], r["tails"]), r["lcps"]))
            cut = np.concatenate(([0], np.cumsum(np.frombuffer(r["left_sizes"], dtype=np.uint8), dtype=np.int64))).tolist()
            lefts.append([r["lefts"][a:b] for a, b in zip(cut, cut[1:], strict=False)])
            buckets.append(r["bucket"])
            ids.append(np.frombuffer(r["ids"], dtype=np.int64))
            offsets.append(np.frombuffer(r["offsets"], dtype=np.uint32).astype(np.int64))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bucket, start, stop
    if runs:
        run, at, lcp = np.array(list(merged(runs)), dtype=np.int64).T
        base = np.cumsum([0, *map(len, ids)])[run] + at
        size = np.array([len(t) for texts, _ in runs for t in texts])[base]
        left = [x for some in lefts for x in some]
        left = [left[i] for i in base.tolist()]
        where = np.concatenate(offsets)[base], np.concatenate(ids)[base], np.array(buckets)[run]
        found += earlier(lcp, size, left, *where)
    if hot[0]:
        order, later, _ = repeats.hot_order(*hot[:3])
        at = np.frombuffer(b"".join(hot[2]), dtype=np.uint32).astype(np.int64)[order][later]
        found.append((np.concatenate(hot[3])[order][later], at, at + LENGTH))
    out = passed + repeats.spans_by_bucket(found)
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})


def earlier(lcp: np.ndarray, size: np.ndarray, left: list[bytes], offset: np.ndarray, doc_id: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From merged suffixes (common prefix with the one before, size, bytes before the anchor, place): the strings that
    start earlier in another: bucket, start, stop."""
    n = len(lcp)
    anchor = np.cumsum(lcp < GRAM)
    # the bytes before the anchors, backwards, sorted for each anchor
    back = [x[::-1] for x in left]
    by_left = sorted(range(n), key=lambda i: (anchor[i], back[i]))
    left_lcp = np.zeros(n, dtype=np.int64)
    for j, (a, b) in enumerate(zip(by_left, by_left[1:], strict=False), 1):
        left_lcp[j] = common(back[a], back[b]) if anchor[a] == anchor[b] else -1
    by_left = np.array(by_left)
    left_size = np.fromiter(map(len, left), dtype=np.int64, count=n)
    first = np.lexsort((offset, doc_id))  # from the earliest on
    out = []
    for shift in range(LEFT + 1):
        need = LENGTH - shift
        stretch, back_stretch = np.cumsum(lcp < need), np.empty(n, dtype=np.int64)
        back_stretch[by_left] = np.cumsum(left_lcp < shift)
        some = first[((left_size >= shift) & (size >= need))[first]]
        key = stretch[some] * (n + 1) + back_stretch[some]
        order = np.argsort(key, kind="stable")
        later = some[order[1:][key[order][1:] == key[order][:-1]]]
        out.append((bucket[later], offset[later] - shift, offset[later] + need))
    return out


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dealt rows of ``docs`` and the spans to remove (bucket, spans; offsets in the bucket's texts)."""
    rows = repeats.dealt(docs, len, LENGTH)
    ranges = repeats.partitions(docs)
    borders = range_borders(docs, ranges)
    anchors = repeats.repeated_anchors(rows, find_anchors)
    runs = rows.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(lambda key, a, b: contexts(key, a, b, borders, ranges), RUNS_SQL)
    return rows, runs.groupBy("part").applyInArrow(merge, "bucket int, spans binary")


def range_borders(docs: DataFrame, parts: int) -> list[bytes]:
    """Borders of the ranges, from one place each in a bounded sample of the texts. They only balance the load."""
    texts = docs.where(F.length("text") > BORDER)
    share = min(1.0, BORDER_TEXTS / max(1, docs.count()))
    place = F.pmod(F.xxhash64("text"), F.octet_length("text") - BORDER).cast("int") + 1
    drawn = texts.sample(share, seed=11).select(F.substring(F.col("text").cast("binary"), place, F.lit(BORDER)).alias("t"))
    some = sorted(bytes(r["t"]) for r in drawn.collect())
    return [some[len(some) * i // parts] for i in range(1, parts)] if some else []


NEW = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs``, and what else the rows hold.

    If wanted, ``text`` is what is left (bytes of a character that was cut through are dropped from it, not from the
    digest).
    """
    done = _deduplicated(docs, with_text)
    return done.select(*[c for c in done.columns if c != "more"], *[F.col(f"more.`{c}`") for c in docs.columns if c.lower() not in NEW])


def _deduplicated(docs: DataFrame, with_text: bool) -> DataFrame:
    """The results, and the rows' other columns as one struct (more)."""
    rows, spans = removed_spans(docs)
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text
    schema += f", more {rows.schema['more'].dataType.simpleString()}" if others else ""

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table, found: pa.Table) -> pa.Table:
        bucket = repeats.Bucket(group)
        starts, stops = repeats.spans_of(found.column("spans").to_pylist())
        out: tuple[list, ...] = ([], [], [], [], [], [], [])

        def put(doc_id: int, n: int, more: dict | None, n_spans: int, kept: bytes) -> None:
            text = kept.decode("utf-8", "ignore") if with_text else None
            for column, value in zip(out, (doc_id, n, n - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), text, more), strict=True):
                column.append(value)

        for *row, text in bucket.short:
            put(*row, 0, text)
        for row in bucket.copies:
            put(*row, 1, b"")
        base = 0
        for text, ids in zip(bucket.texts, bucket.ids, strict=True):
            # texts stand end to end, so two spans that touch at a border of texts may have become one
            i, j = np.searchsorted(stops, base, side="right"), np.searchsorted(starts, base + len(text))
            pieces, at = [], 0
            for a, b in zip(starts[i:j].tolist(), stops[i:j].tolist(), strict=True):
                pieces.append(text[at : max(a - base, 0)])
                at = b - base
            pieces.append(text[at:])
            put(*ids[0], int(j - i), b"".join(pieces))
            for row in ids[1:]:
                put(*row, 1, b"")
            base += len(text)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), group.schema.field("more").type]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text" if with_text else None, "more" if others else None]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, out, kinds, strict=True) if name})

    return rows.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts without what starts earlier; documents that lose all their bytes go."""
    kept = _deduplicated(docs, with_text=True).where("n_removed < n_bytes OR n_bytes = 0")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own.get(c, F.col(f"more.`{c}`")).alias(c) for c in docs.columns])
