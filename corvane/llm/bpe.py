"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can end its encoding. A suffix-matching automaton over the vocabulary
(Aho-Corasick: its failure links lead from each state to the longest suffix that is a prefix of a token) gives all tokens
that are suffixes of the prefix; the one that is compatible with the last token of what stands before it (no merge
of lower rank would have joined across their border) is stored, and following the back-pointers from the whole word
emits the exact ids. Words are encoded once for each cache; the caches have a fixed size and hold no long words.

Null texts count as empty; an empty text has no ids and decodes to the empty string. Texts of any length are encoded
whole. Rows with a null id are kept; repeated rows each give a row. Nothing depends on the order of rows. Further columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table
from corvane.llm.mixing import PLACE

#: Entries that a worker's caches of pieces, words and token pairs hold before they are emptied.
PIECES, WORDS, PAIRS = 400_000, 200_000, 300_000
#: Characters of a word or piece that is cached, at most.
LONG = 64
#: Unicode white space, which separates words and is dropped.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder for a tokenizers file: byte-level BPE whose words end in a suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunk = regex.compile(f"[^{BLANK}]+")
        self.symbols = byte_symbols()
        # Symbols are single characters here; the last symbol of a word is marked by moving it to another plane.
        self.rank_of: dict[str, int] = {}
        self.ids: list[int] = []
        self.halves: list[tuple[int, int]] = []
        self.pairs: dict[tuple[int, int], int] = {}
        for s in self.symbols:
            for last in (False, True):
                self._add(self._packed(s, last), vocab[s + (self.suffix if last else "")], None)
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self._known(left), self._known(right)
            if a is None or b is None or (a, b) in self.pairs:
                continue
            joined = left + right
            packed = self._packed(joined.removesuffix(self.suffix), bool(self.suffix) and joined.endswith(self.suffix))
            rank = self.rank_of.get(packed)
            if rank is None:
                rank = self._add(packed, vocab[joined], (a, b))
            self.pairs[a, b] = rank
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.rank_of.items():
            if self._reachable(rank):
                self.automaton.add_word(text, (rank, len(text)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _packed(symbols: str, last: bool) -> str:
        return symbols[:-1] + chr(0x10000 + ord(symbols[-1])) if last else symbols

    def _known(self, token: str) -> int | None:
        last = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        return self.rank_of.get(self._packed(token.removesuffix(self.suffix) if last else token, last))

    def _add(self, packed: str, token_id: int, halves: tuple[int, int] | None) -> int:
        rank = self.rank_of[packed] = len(self.ids)
        self.ids.append(token_id)
        self.halves.append(halves or (rank, rank))
        return rank

    def _reachable(self, rank: int) -> bool:
        """A token that its own encoding gives back: its halves may stand side by side until their merge."""
        a, b = self.halves[rank]
        return a == rank == b or self.compatible(a, b, self.pairs[a, b])

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the two tokens may stand side by side: no merge across their border comes before (or at all)."""
        limit = len(self.ids) if below is None else below
        while True:
            merge = self.pairs.get((left, right))
            if merge is not None and merge < limit:
                return False
            # Undo the later of the two merges; before it, merges across the border had to rank under it.
            if left > right or (left == right and self.halves[left][0] != left):
                a, inner = self.halves[left]
                if a == left == inner:
                    return True
                limit, left = min(limit, left), inner
            else:
                inner, b = self.halves[right]
                if inner == right == b:
                    if self.halves[left] == (left, left):
                        return True
                    limit, left = min(limit, left), self.halves[left][1]
                else:
                    limit, right = min(limit, right + 1), inner

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token (never empty)."""
        if (known := self.words.get(word)) is not None:
            return known
        text = self._packed("".join(map(self.symbols.__getitem__, word.encode())), True) if self.suffix else "".join(map(self.symbols.__getitem__, word.encode()))
        last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        fits = self.fits
        for end, (rank, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                ok = fits.get((before, rank))
                if ok is None:
                    ok = fits[before, rank] = self.compatible(before, rank)
                if not ok:
                    continue
            last[end], back[end] = rank, begin
        out, at = [], len(text)
        while at:
            out.append(self.ids[last[at]])
            at = back[at]
        found = tuple(reversed(out))
        if len(word) <= LONG:
            self.words[word] = found
            if len(self.words) > WORDS:
                self.words.clear()
        if len(fits) > PAIRS:
            fits.clear()
        return found

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", text))

    def encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits each) and decoded text of a piece without white space."""
        ids: list[int] = []
        for part in self.marks.split(chunk) if self.marks and "<|" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.word.findall(self.normalized(part)):
                    ids.extend(self.encode_word(word))
        return b"".join(i.to_bytes(4, "little") for i in ids), " ".join(map(self.names.__getitem__, ids))

    def forget(self) -> None:
        """Empty all caches, so that an idle worker holds no more than the vocabulary."""
        self.chunks.clear()
        self.words.clear()
        self.fits.clear()

    def encode(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of a text, packed, and the decoded text in pieces to be joined by one space."""
        pieces = self.chunk.findall(text)
        known = self.chunks
        new = set(pieces).difference(known)
        for p in new:
            known[p] = self.encode_chunk(p)
        found = [known[p] for p in pieces]
        for p in new:
            if len(p) > LONG:
                del known[p]
        if len(known) > PIECES:
            known.clear()
        return b"".join([f[0] for f in found]), [f[1] for f in found if f[1]]


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode ``docs`` (doc_id, text): doc_id, n_tokens, ids, decoded.

    The vocabulary (of fixed size) is read once on the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(source.value)
        for batch in rows:
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                packed, pieces = codec.encode(text or "")
                decoded = " ".join(pieces)
                ids.append(packed)
                texts.append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
        codec.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer_path: str, place: str | None = None) -> DataFrame:
    """As ``encoded``, with SHA-256 digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``place``: a column of whole numbers to hand on as ``position``.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(source.value)
        for batch in rows:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text"):
                packed, pieces = codec.encode(text.as_py() or "")
                out[0].append(len(packed) // 4)
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(hashlib.sha256(" ".join(pieces).encode()).hexdigest())
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(out[0], pa.int64()), "ids_sha256": pa.array(out[1], pa.string()), "decoded_sha256": pa.array(out[2], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"position": batch.column(place)} if place else {}))
        codec.forget()

    return docs.select("doc_id", "text", *([place] if place else [])).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", position bigint" if place else ""))


_codecs: dict[str, Codec] = {}


def shared(source: str) -> Codec:
    """One codec for each worker process, kept between its tasks."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source)
    return _codecs[key]


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token count, digests and, after the mixing stage, position of every document that is left."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("word_bpe_49k.json"), PLACE if PLACE in docs.columns else None)
