"""Steps shared by the operators that remove repeated passages (a byte or word sequence of fixed length that occurs again).

Texts are dealt over buckets by digest, so that exact copies meet and count once. In every passage of the given length
the least of its gram hashes is an anchor (winnowing), so two equal passages share an anchor at the same place. Anchors
that occur once in the whole corpus are dropped; around each of the others a context, which holds all passages with that
anchor, goes to where the operator compares contexts with equal anchors.

Copies that a task has seen already, short texts and anchors that repeat within a bucket take ways of their own, so a
text, line or anchor that a third of the rows share doesn't gather in one task. An anchor that occurs more than HOT times
is hot: the passages around it are not compared side by side but dealt one by one, by their digest, and of equal ones a
bucket sends one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets for each shuffle partition; bytes of text whose hashes are computed at once.
BUCKETS, PIECE = 4, 1_000_000
#: Occurrences of an anchor up to which its contexts go to one place.
HOT = 4096
LOW32 = np.uint64(0xFFFFFFFF)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(docs: DataFrame, measure: Callable[[bytes], int], shortest: int) -> DataFrame:
    """Deal ``docs`` (doc_id, text and any others) over buckets: bucket, doc_id, digest, text, n, more.

    ``more`` holds the other columns. ``n`` is ``measure(text)``. Rows without a digest are texts under ``shortest``, which nothing can be removed from;
    rows without a text are copies of a text with a smaller or equal id; a row without an id says that a digest repeats.
    """
    count = BUCKETS * partitions(docs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    more = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), more.alias("more"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        again: set[bytes] = set()
        schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("n", pa.int64())])
        rest_type = pa.bool_()
        for batch in (b.slice(i, 1000) for b in rows for i in range(0, max(1, len(b)), 1000)):
            rest_type = batch.column(2).type
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                n = measure(raw)
                digest, kept = hashlib.blake2b(raw, digest_size=16).digest(), raw
                bucket = int.from_bytes(digest[:6], "little") % count
                if n < shortest:
                    digest, bucket = None, doc_id % count
                elif least.get(digest, doc_id + 1) <= doc_id:
                    again.add(digest)
                    kept, bucket = None, doc_id % count
                else:
                    if digest in least:
                        again.add(digest)
                    least[digest] = doc_id
                for column, value in zip(out, (bucket, doc_id, digest, kept, n), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, schema, strict=True)), batch.column(2)], [*schema.names, "more"])
        if again:
            some = sorted(again)
            notes = [[int.from_bytes(d[:6], "little") % count for d in some], None, some, None, None]
            columns = [pa.nulls(len(some), f.type) if c is None else pa.array(c, f.type) for c, f in zip(notes, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(some), rest_type)], [*schema.names, "more"])

    return docs.mapInArrow(run, f"bucket int, doc_id bigint, digest binary, text binary, n bigint, more {docs.schema['more'].dataType.simpleString()}")


class Bucket:
    """The rows of one bucket: distinct long texts in the order of their digests, and what needs no comparison."""

    def __init__(self, rows: pa.Table):
        found: dict[bytes, bytes] = {}
        ids: dict[bytes, list[tuple[int, int, dict | None]]] = defaultdict(list)
        self.short: list[tuple[int, int, dict | None, bytes]] = []
        self.copies: list[tuple[int, int, dict | None]] = []
        noted = set()
        for doc_id, digest, text, n, more in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "digest", "text", "n", "more")), strict=True):
            if doc_id is None:
                noted.add(digest)
            elif digest is None:
                self.short.append((doc_id, n, more, text))
            elif text is None:
                self.copies.append((doc_id, n, more))
            else:
                found[digest] = text
                ids[digest].append((doc_id, n, more))
        order = sorted(found)
        self.texts = [found[d] for d in order]
        self.ids = [sorted(ids[d], key=lambda x: x[:2]) for d in order]
        self.many = [len(ids[d]) > 1 or d in noted for d in order]


def winnowed(hashes: np.ndarray, begin: np.ndarray, length: np.ndarray, gram: int, passage: int) -> np.ndarray:
    """Places of the anchors: in each passage the rightmost of its least gram hashes (of their upper halves)."""
    width, n = passage - gram + 1, len(hashes)
    if n < width or not (length >= passage).any():
        return np.zeros(0, dtype=np.int64)
    least = (hashes & ~LOW32) | (LOW32 - np.arange(n, dtype=np.uint64))
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    inside = np.zeros(n + 2, dtype=np.int32)
    enough = length >= passage
    np.add.at(inside, begin[enough], 1)
    np.add.at(inside, begin[enough] + length[enough] - passage + 1, -1)
    place = (LOW32 - (least[np.cumsum(inside[: len(least)]) > 0] & LOW32)).astype(np.int64)
    return place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place


def packed(offsets: np.ndarray) -> bytes:
    """Ascending offsets as differences, low and high halves apart."""
    step = np.diff(offsets, prepend=0).astype(np.uint32)
    return (step & 0xFFFF).astype(np.uint16).tobytes() + (step >> 16).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, dtype=np.uint16).reshape(2, -1).astype(np.int64)
    return np.cumsum(low + (high << 16))


def ids40(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray((hashes >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def repeated_anchors(rows: DataFrame, find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """For each bucket the anchors that occur again in the corpus: bucket, offsets (packed), hot, maybe in several rows.

    Rows that are hot hold the first offset in the bucket of each hot anchor, which other rows may hold too. ``find`` gives for the texts of a bucket the anchors' offsets (in the texts laid end to end) and hashes.
    """
    parts = partitions(rows)

    def split(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        out = defaultdict(list)

        def put(part: int, known: bool, ids: bytes, times: np.ndarray, offsets: np.ndarray) -> None:
            for k, v in (("part", part), ("bucket", key[0].as_py()), ("known", known), ("ids", ids), ("times", times.astype(np.uint32).tobytes()), ("offsets", packed(offsets))):
                out[k].append(v)

        offsets, hashes = find(Bucket(group).texts)
        if len(offsets):
            _, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            if twice.any():
                put(key[0].as_py() % parts, True, b"", times[:0], offsets[twice])
            order = np.argsort(first)
            first, times = first[order], times[order]
            offsets, hashes = offsets[first], hashes[first]
            to = ((hashes & LOW32) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            for some in np.split(order, edges[1:]):
                put(int(to[some[0]]), False, ids40(hashes[some]), times[some], offsets[some])
        return pa.table([pa.array(out[f.name], f.type) for f in SPLIT], schema=SPLIT)

    def judge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        known = group.column("known").to_pylist()
        buckets, offsets = group.column("bucket").to_pylist(), group.column("offsets").to_pylist()
        ids = [from40(x) for x in group.column("ids").to_pylist()]
        times = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group.column("times").to_pylist()])
        _, back, n = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
        again, hot = n[back] > 1, np.bincount(back, weights=times)[back] > HOT
        out, at = ([], [], []), 0
        for bucket, is_known, raw, own in zip(buckets, known, offsets, ids, strict=True):
            mine = slice(at, at + len(own))
            at += len(own)
            for wanted, is_hot in ((again[mine] & ~hot[mine], False), (hot[mine], True)):
                if (is_known and not is_hot) or wanted.any():
                    for column, value in zip(out, (bucket, raw if is_known else packed(unpacked(raw)[wanted]), is_hot), strict=True):
                        column.append(value)
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "offsets": pa.array(out[1], pa.binary()), "hot": pa.array(out[2], pa.bool_())})

    found = rows.groupBy("bucket").applyInArrow(split, "part int, bucket int, known boolean, ids binary, times binary, offsets binary")
    return found.groupBy("part").applyInArrow(judge, "bucket int, offsets binary, hot boolean")


SPLIT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("known", pa.bool_()), ("ids", pa.binary()), ("times", pa.binary()), ("offsets", pa.binary())])


def offsets_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All repeated anchors of a bucket, and the first of each hot one, ascending."""
    found: tuple[list, list] = ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)])
    for raw, hot in zip(group.column("offsets").to_pylist(), group.column("hot").to_pylist(), strict=True):
        found[0].append(unpacked(raw))
        if hot:
            found[1].append(found[0][-1])
    return np.unique(np.concatenate(found[0])), np.unique(np.concatenate(found[1]))


def passage_digest(passage: bytes) -> bytes:
    return hashlib.blake2b(passage, digest_size=16).digest()


def hot_rows(passages: dict[bytes, tuple[int, int]], parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The passages around hot anchors (digest: id, offset) of a bucket by part: part, digests, ids, offsets."""
    if passages:
        to = np.array([int.from_bytes(d[:4], "little") % parts for d in passages])
        digests, places = np.array(list(passages), dtype="V16"), np.array(list(passages.values()), dtype=np.int64)
        order = np.argsort(to, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            yield int(to[some[0]]), digests[some].tobytes(), places[some, 0].tobytes(), places[some, 1].astype(np.uint32).tobytes()


def hot_order(digests: list[bytes], ids: list[bytes], offsets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of all passages by digest, id and offset; where in it a passage is not the first and not the only one."""
    high, low = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2).T
    order = np.lexsort((np.frombuffer(b"".join(offsets), dtype=np.uint32), np.frombuffer(b"".join(ids), dtype=np.int64), low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    no = np.zeros(1, dtype=bool)
    later = np.concatenate((no, same))
    return order, later, later | np.concatenate((same, no))


def covered(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as ascending, disjoint and not adjacent ones."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > stops[:-1]))
    return starts[new], stops[np.concatenate((new[1:], [True]))]


def spans_packed(starts: list[int] | np.ndarray, stops: list[int] | np.ndarray) -> bytes:
    starts, stops = covered(np.asarray(starts, dtype=np.int64), np.asarray(stops, dtype=np.int64))
    return np.concatenate((starts, stops - starts)).astype(np.uint32).tobytes()


def spans_by_bucket(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, bytes]]:
    """Spans (bucket, start, stop) packed for each bucket."""
    if not found:
        return []
    bucket, start, stop = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(bucket, kind="stable")
    return [(int(bucket[i[0]]), spans_packed(start[i], stop[i])) for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(i)]


def spans_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [np.frombuffer(x, dtype=np.uint32).reshape(2, -1).astype(np.int64) for x in raws]
    both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    return covered(both[0], both[0] + both[1])
