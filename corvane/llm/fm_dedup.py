"""Substring dedup: remove every word of a 35-word window whose word sequence starts anywhere else too.

Words are the runs of other bytes than ASCII white space. Anchors that repeat (see ``repeats``) deal the word contexts
around them over shards; each shard builds an FM-index over its contexts: the Burrows-Wheeler transform of the word
numbers in a wavelet matrix of packed bits. The contexts are then streamed against the index by backward search, which
gives how far a sequence can be carried to the left while it still occurs twice; stretches of 35 words or more are
reported. The word at the anchor is marked, so each place in the corpus counts once for each anchor.

Equal contexts are one record with a weight; where the weight is two or more, all windows in it repeat. Null texts and
texts under 35 words lose nothing. Rows with a null id are left out. Repeated rows each give a row and count as copies
of each other. Further columns are ignored. An empty table gives an empty result.

What one task holds: a bucket of texts, or the contexts of one shard. A context that many texts share is one record of
each bucket. The windows around an anchor with more than ``repeats.HOT`` occurrences are spread over all shards by digest.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import repeats
from corvane.llm.common import BASE, INVERSE, SPACE, Words, batches, mix64, powers, table

#: Words of a window, and of the grams whose hashes choose the anchors.
WINDOW, GRAM = 35, 18
LEFT = WINDOW - GRAM
MARK = np.uint64(0xA5A5A5A5A5A5A5A5)
BLANK = bytes(np.flatnonzero(SPACE).astype(np.uint8))


class WaveletMatrix:
    """Rank queries over a sequence of numbers: one packed bit vector for each bit of them, from the highest on."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits = bits
        self.words, self.before, self.zeros = [], [], []
        n = len(sequence)
        for b in range(bits - 1, -1, -1):
            bit = ((sequence >> b) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, dtype=bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def ranks(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before lo and before hi."""
        at = np.concatenate((lo, hi))
        start = np.zeros(len(symbols), dtype=np.int64)
        n = len(symbols)
        both = np.concatenate((at, start))
        for level in range(self.bits):
            block, inside = both >> 6, (both & 63).astype(np.uint64)
            ones = self.before[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << inside) - np.uint64(1)))
            up = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            both = np.where(np.concatenate((up, up, up)), self.zeros[level] + ones, both - ones)
        return both[:n] - both[2 * n :], both[n : 2 * n] - both[2 * n :]


class FMIndex:
    """The index of numbered words; sequences are parted by zeros and counted by weight.

    Ranks are held for the first WINDOW words of each suffix, as no longer sequence is looked up at once.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank = sequence.astype(np.int64)
        span = 1
        order = np.argsort(rank, kind="stable")
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[: max(0, n - span)] = rank[span:] + 1
            key = rank * np.int64(rank.max() + 2) + following
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            span *= 2
            if span >= depth or rank.max() == n - 1:
                break
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(sequence))))
        self.matrix = WaveletMatrix(sequence[order - 1], max(1, int(sequence.max()).bit_length()))

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that start with the symbol and go on with the former match."""
        a, b = self.matrix.ranks(symbols, lo, hi)
        return self.starts[symbols] + a, self.starts[symbols] + b


def repeated_windows(sequences: np.ndarray, begin: np.ndarray, size: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the wanted sequences in which each window also starts at another place: sequence, start, stop.

    ``sequences`` holds numbers from 1 on; sequence i is at begin[i] .. begin[i] + size[i], parted by zeros.
    """
    # The transform needs exact order only as far as a sequence is looked up.
    index = FMIndex(sequences, int(size.max()) + 1)
    who = np.flatnonzero(wanted & (size >= window))
    end = size[who].copy()  # look for windows that end here or before
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        lo, hi = np.zeros(len(who), dtype=np.int64), np.full(len(who), len(sequences), dtype=np.int64)
        at = end.copy()  # the match so far is at .. end
        live = np.arange(len(who))
        while len(live):
            a, b = index.extend(sequences[begin[who[live]] + at[live] - 1], lo[live], hi[live])
            ok = b - a >= 2
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            at[live] -= 1
            live = live[at[live] > 0]
        found = end - at >= window
        out.append((who[found], at[found], end[found]))
        # at - 1 .. end occurs once, so further windows start before it and end before this end
        end = np.minimum(at - 1 + window, end - 1)
        more = (at > 0) & (end >= window)
        who, end = who[more], end[more]
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def pieces(texts: list[bytes]):
    """Words of the texts, some texts at a time: index of the first text, words."""
    for b, e in batches(texts, repeats.PIECE):
        yield b, Words(texts[b:e])


def find_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (in words of the texts laid end to end) and gram hashes of all anchors."""
    offsets, hashes, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for _, w in pieces(texts):
        grams = w.grams(GRAM)
        place = repeats.winnowed(grams, w.first[:-1], np.diff(w.first), GRAM, WINDOW)
        offsets.append(place + done)
        hashes.append(grams[place])
        done += len(w.hash)
    return np.concatenate(offsets), np.concatenate(hashes)


SHARDS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("spans", pa.binary()), ("texts", pa.list_(pa.binary())), ("places", pa.binary()), ("weights", pa.binary()), ("offsets", pa.binary()), ("hot", pa.binary()), ("hot_offsets", pa.binary())])
SHARDS_SQL = "part int, bucket int, spans binary, texts array<binary>, places binary, weights binary, offsets binary, hot binary, hot_offsets binary"


def contexts(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table, parts: int) -> pa.Table:
    """The distinct contexts of a bucket for each shard; those that the bucket has twice are covered at once. Of hot anchors
    the digests of the windows around them."""
    bucket = repeats.Bucket(rows)
    wanted, firsts = repeats.offsets_of(anchors)
    to, seen_hash, words, places, where, ends, many, hot = [], [], [], [], [], [], [], []
    done, hot_grams = 0, np.zeros(0, dtype=np.uint64)
    for first_text, w in pieces(bucket.texts) if len(wanted) else ():
        n = len(w.hash)
        at = wanted[np.searchsorted(wanted, done) : np.searchsorted(wanted, done + n)] - done
        grams = w.grams(GRAM)
        doc = w.doc[at] if len(w.doc) == n else np.searchsorted(w.first, at, side="right") - 1
        lo, hi = np.maximum(w.first[doc], at - LEFT), np.minimum(w.first[doc + 1], at + WINDOW)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * powers(BASE, n))))
        whole = mix64((prefix[hi] - prefix[lo]) * powers(INVERSE, n + 1)[lo]) ^ mix64(((hi - lo) * 64 + at - lo).astype(np.uint64))
        # the first place of a hot anchor comes before its others
        hot_grams = np.concatenate((hot_grams, grams[firsts[np.searchsorted(firsts, done) : np.searchsorted(firsts, done + n)] - done]))
        hot.append(np.isin(grams[at], hot_grams))
        to.append(grams[at] & repeats.LOW32)
        seen_hash.append(whole)
        places.append(at - lo)
        where.append(at + done)
        ends.append(hi - lo)
        many.append(np.array(bucket.many)[first_text + doc])
        words += [b" ".join(w.data[a:b].split()) for a, b in zip(w.start[lo].tolist(), w.end[hi - 1].tolist(), strict=True)]
        done += n
    out: dict[int, dict] = defaultdict(dict)  # one row for each shard
    if words:
        to, seen_hash, places, where, ends, many, hot = map(np.concatenate, (to, seen_hash, places, where, ends, many, hot))
        _, first, back, times = np.unique(seen_hash, return_index=True, return_inverse=True, return_counts=True)
        weight = np.minimum(times + np.bincount(back, weights=many, minlength=len(first)).astype(np.int64), 2)
        known = (weight[back] > 1) & ~many
        starts, stops = [(where - places)[known]], [(where - places + ends)[known]]
        windows: dict[bytes, set[int]] = defaultdict(set)  # two anchors may have a window in common
        twice = set()
        for j in np.flatnonzero(hot[first]).tolist():
            i = first[j]
            sequence, base = words[i].split(b" "), int(where[i] - places[i])
            for a in range(min(int(places[i]), len(sequence) - WINDOW) + 1):
                digest = repeats.passage_digest(b" ".join(sequence[a : a + WINDOW]))
                windows[digest].add(base + a)
                if weight[j] > 1:
                    twice.add(digest)
        again = np.array([x for d, at in windows.items() if len(at) > 1 or d in twice for x in at], dtype=np.int64)
        starts, stops = np.concatenate((*starts, again)), np.concatenate((*stops, again + WINDOW))
        if len(starts):
            out[key[0].as_py() % parts]["spans"] = repeats.spans_packed(starts, stops)
        for to_part, digests, _, at in repeats.hot_rows({d: (0, min(at)) for d, at in windows.items()}, parts):
            out[to_part] |= {"hot": digests, "hot_offsets": at}
        part = (to[first] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        order = order[~hot[first[order]]]
        for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
            i = first[some]
            out[int(part[some[0]])] |= {"texts": [words[j] for j in i], "places": places[i].astype(np.uint8).tobytes(), "weights": weight[some].astype(np.uint8).tobytes(), "offsets": where[i].astype(np.uint32).tobytes()}
    rows_out = [{"part": part, "bucket": key[0].as_py()} | row for part, row in out.items()]
    return pa.Table.from_pylist(rows_out, schema=SHARDS)


def search(group: pa.Table) -> pa.Table:
    """Build the shard's index and stream its contexts against it: bucket, spans."""
    out = [(r["bucket"], r["spans"]) for r in group.select(["bucket", "spans"]).to_pylist() if r["spans"] is not None]
    hot = [r for r in group.select(["bucket", "hot", "hot_offsets"]).to_pylist() if r["hot"] is not None]
    found = []
    if hot:
        order, _, again = repeats.hot_order([r["hot"] for r in hot], [bytes(len(r["hot"]) // 2) for r in hot], [r["hot_offsets"] for r in hot])
        at = np.frombuffer(b"".join(r["hot_offsets"] for r in hot), dtype=np.uint32).astype(np.int64)[order][again]
        found.append((np.repeat([r["bucket"] for r in hot], [len(r["hot"]) // 16 for r in hot])[order][again], at, at + WINDOW))
    group = group.filter(pc.is_valid(group.column("texts")))
    if len(group):
        found.append(indexed(group))
    out += repeats.spans_by_bucket(found)
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})


def indexed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated stretches of a shard's contexts: bucket, start, stop."""
    texts = [t for x in group.column("texts").to_pylist() for t in x]
    join = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in group.column(name).to_pylist()])
    places, weights, offsets = join("places", np.uint8).astype(np.int64), join("weights", np.uint8).astype(np.int64), join("offsets", np.uint32).astype(np.int64)
    buckets = np.repeat(group.column("bucket").to_numpy(), [len(x) // 4 for x in group.column("offsets").to_pylist()])
    hashes, sizes = [], []
    for b, e in batches(texts, repeats.PIECE):
        w = Words(texts[b:e])
        h = w.hash.copy()
        h[w.first[:-1] + places[b:e]] ^= MARK
        hashes.append(h)
        sizes.append(np.diff(w.first))
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    begin = np.cumsum(sizes) - sizes
    # equal contexts of several buckets: one sequence with the sum of the weights
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)))))
    whole = mix64((prefix[begin + sizes] - prefix[begin]) * powers(INVERSE, len(hashes) + 1)[begin] + sizes.astype(np.uint64))
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    weight = np.bincount(back, weights=weights)
    begin1, size1 = begin[first], sizes[first]
    number = np.unique(hashes, return_inverse=True)[1] + 1
    new_begin = np.cumsum(size1 + 1) - size1 - 1
    sequence = np.zeros(int((size1 + 1).sum()), dtype=np.int64)
    inside = np.repeat(new_begin - (np.cumsum(size1) - size1), size1) + np.arange(size1.sum())
    sequence[inside] = number[np.repeat(begin1 - (np.cumsum(size1) - size1), size1) + np.arange(size1.sum())]
    who, starts, stops = repeated_windows(sequence, new_begin, size1, weight < 2)
    # every record (with its own place) of a sequence that came twice is covered whole
    full = np.flatnonzero((weight[back] > 1) & (weights < 2))
    base = offsets - places
    one = first[who]
    b = np.concatenate((buckets[full], buckets[one]))
    s = np.concatenate((base[full], base[one] + starts))
    e = np.concatenate((base[full] + sizes[full], base[one] + stops))
    return b, s, e


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, ``kept`` (the words left, joined by spaces) for each row."""
    rows = repeats.dealt(docs.select("doc_id", "text"), lambda text: len(text.split()), WINDOW)
    anchors = repeats.repeated_anchors(rows, find_anchors)
    parts = repeats.partitions(docs)

    def gather(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        return contexts(key, a, b, parts)

    shards = rows.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(gather, SHARDS_SQL)
    spans = shards.groupBy("part").applyInArrow(search, "bucket int, spans binary")

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table, found: pa.Table) -> pa.Table:
        bucket = repeats.Bucket(group)
        starts, stops = repeats.spans_of(found.column("spans").to_pylist())
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(doc_id: int, n: int, kept: list[bytes]) -> None:
            text = b" ".join(kept)
            for column, value in zip(out, (doc_id, n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None), strict=True):
                column.append(value)

        for doc_id, n, _, text in bucket.short:
            put(doc_id, n, text.split())
        for doc_id, n, _ in bucket.copies:
            put(doc_id, n, [])
        base = 0
        for text, ids, many in zip(bucket.texts, bucket.ids, bucket.many, strict=True):
            n = ids[0][1]
            if many:
                for doc_id, _, _ in ids:
                    put(doc_id, n, [])
            else:
                words = text.split()
                i, j = np.searchsorted(stops, base, side="right"), np.searchsorted(starts, base + n)
                kept, at = [], 0
                for a, b in zip(starts[i:j].tolist(), stops[i:j].tolist(), strict=True):
                    kept += words[at : max(a - base, 0)]
                    at = b - base
                kept += words[at:]
                put(ids[0][0], n, kept)
            base += n
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, out, kinds, strict=False)})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return rows.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, schema)


def op1_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 35-word windows that occur again."""
    return deduplicated(table(spark, sf_dir, "documents"), with_text=False)
