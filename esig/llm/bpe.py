"""Byte-level BPE encoding and decoding as a monoid over text segments.

A segment is (start, end, ids). Segments of at most ``leaf_chars`` code points are encoded directly; two
neighbours are joined by encoding a window around their boundary again. The window grows until both of its ends
are places where the encoding provably cannot depend on what lies beyond, so tokens outside it stand:

* *Cut*: the pre-tokenizer always ends a match where a letter, digit or other symbol is followed by a character
  of another class (but for an apostrophe before a letter, which may open a contraction). No alternative of the
  pattern spans such a place and none looks across it.
* *Stable pair*: inside one unbroken run of letters, digits or symbols there is no cut near. There a window of
  whole tokens is encoded again, and stands as soon as the pair of tokens at each of its ends encodes to itself:
  a BPE token sequence is the encoding of its bytes exactly if every neighbouring pair is.

Decoding concatenates the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import text_chunks, with_field

#: Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A rank file larger than this is refused rather than broadcast.
MAX_RANK_BYTES = 64 << 20
ENCODE_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class TreeCodec:
    """Encode and decode one text by tree reduction; a leaf goes to the public tokenizer library."""

    def __init__(self, ranks: dict[bytes, int], leaf_chars: int = 2048, first_window: int = 32, run_window: int = 512):
        import regex
        import tiktoken

        self.enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.enc._core_bpe.encode_single_piece
        self.leaf, self.first, self.run = leaf_chars, first_window, run_window
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._class = regex.compile(r"(\s)|(\p{L})|(\p{N})|(.)", regex.S).match

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.enc.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self._encode(text, a, mid), self._encode(text, mid, b))

    def _is_cut(self, text: str, p: int) -> bool:
        left, right = self._class(text, p - 1).lastindex, self._class(text, p).lastindex
        return left != 1 and left != right and not (text[p - 1] == "'" and right == 2)

    def join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[a:b] from those of text[a:mid] and text[mid:b]."""
        width, lo, hi = self.first, None, None
        while lo is None or hi is None:
            if lo is None:
                lo = next((p for p in range(mid - 1, max(a, mid - width), -1) if self._is_cut(text, p)), a if mid - width <= a else None)
            if hi is None:
                hi = next((p for p in range(mid + 1, min(b, mid + width)) if self._is_cut(text, p)), b if mid + width >= b else None)
            if (lo is None or hi is None) and width >= self.run and (got := self._join_run(text, mid, width, left, right)) is not None:
                return got
            width *= 2
        before, after = len(text[lo:mid].encode()), len(text[mid:hi].encode())
        i, j = len(left), 0
        while before > 0:
            i -= 1
            before -= len(self.bytes_of[left[i]])
        while after > 0:
            after -= len(self.bytes_of[right[j]])
            j += 1
        return left[:i] + self.enc.encode_ordinary(text[lo:hi]) + right[j:]

    def _join_run(self, text: str, mid: int, width: int, left: list[int], right: list[int]) -> list[int] | None:
        """Join inside one run of a class; None if the boundary isn't inside one or no window settles within it."""
        around = text[mid - width : mid + width]
        kind = self._class(around, 0).lastindex
        if kind == 1 or len(around) < 2 * width or any(self._class(c).lastindex != kind for c in around):
            return None
        room = width // 2  # tokens of at least one byte each: bytes of the run on each side that windows may use
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            body = [self.bytes_of[t] for t in left[i:]], [self.bytes_of[t] for t in right[:j]]
            if i < 1 or j >= len(right) or max(sum(map(len, body[0])), sum(map(len, body[1]))) + 2 * len(self.bytes_of[left[i - 1]]) + 2 * len(self.bytes_of[right[j]]) > room:
                return None
            new = self.piece(b"".join(body[0] + body[1]))
            if self._stable(left[i - 1], new[0]) and self._stable(new[-1], right[j]):
                return left[:i] + new + right[j:]
            k *= 2

    def _stable(self, x: int, y: int) -> bool:
        return self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, halves first."""
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple, TreeCodec] = {}


def _codec(data: bytes, leaf_chars: int) -> TreeCodec:
    """One codec for each Python worker and vocabulary."""
    key = (hashlib.sha256(data).digest(), leaf_chars)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(read_ranks(data), leaf_chars)
    return _CODECS[key]


def _rank_bytes(ranks_path: str) -> bytes:
    with open(ranks_path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{ranks_path} has more than {MAX_RANK_BYTES} bytes")
    return data


def encode_bpe(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", exact: str | None = None, leaf_chars: int = 2048) -> DataFrame:
    """``docs`` with an array column ``ids`` of the tokens of each whole ``text`` (an old column of that name goes).

    With ``exact`` a boolean column of that name tells whether the decoded ids give back the text's bytes. Null and
    empty texts have no tokens. Rows neither move nor merge, so repeated rows each keep their own result.
    """
    data = docs.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))
    kept = docs.drop(ids, *[exact] * bool(exact))
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, leaf_chars)
        for b in text_chunks(batches, at):
            texts = b.column(at).to_pylist()
            found = [codec.encode(t) if t else [] for t in texts]
            more = [pa.array([codec.decode(x) == (t or "").encode() for x, t in zip(found, texts, strict=True)], pa.bool_())] * bool(exact)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32())), *more], names=[*b.schema.names, ids, *[exact] * bool(exact)])

    schema = with_field(kept.schema, ids, "array<int>")
    return kept.mapInArrow(run, with_field(schema, exact, "boolean") if exact else schema)


def decode_bpe(tokens: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of each ``ids`` array as binary column ``out``; null where the array is null."""
    data = tokens.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))
    kept = tokens.drop(out)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, 2048)
        for b in batches:
            found = [None if x is None else codec.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, out])

    return kept.mapInArrow(run, with_field(kept.schema, out, "binary"))


def bpe_digest(docs: DataFrame, ranks_path: str, leaf_chars: int = 2048) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the little-endian ids and of the bytes decoded from them.

    Encodes and decodes in one pass over the texts; only the digests leave the task. Null text counts as empty;
    every row gives one row, in whatever number a doc_id comes; other columns are not read.
    """
    data = docs.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, leaf_chars)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t) if t else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODE_SCHEMA)
