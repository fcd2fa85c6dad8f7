"""Byte-level BPE by monoid tree reduction.

A segment's value is its token sequence. Single bytes are the leaves; a segment encodes its two halves and joins them.
The join re-encodes a window around the boundary and widens it on each side until the window's outermost token there is
the one that stood there before (or the segment ends). BPE sequences are exactly those in which every two neighbours
are stable under re-encoding, so tokens outside such a window provably stay and the joined sequence is the encoding of
the whole. The join is associative, so halves can be cut anywhere; a run of n bytes costs O(n log n) and never n².
Decoding concatenates token bytes up the same kind of tree.

Edge cases: a null text is empty; an empty text has no tokens and the digests of no bytes; each row is encoded by
itself, so repeated rows give equal results; equal ranks cannot occur, and of two places with the lowest rank the left one
merges first; very long texts are held one group at a time, very long pieces cost O(n log n); other columns of the table,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.chunks import Chunks
from tactus.llm.common import no_null, table, vocabulary

#: Remembered joins, segments and pieces, chunks of one generation, and bytes of text handled at a time: a bound on a worker's
#: memory, which it keeps through later stages. Longer ones are not remembered.
MEMORY = 200_000
CHUNKS = 150_000
GROUP_BYTES = 1 << 21
SEGMENT_BYTES = 6
PIECE_BYTES = 24
NEVER = 1 << 60


class Bpe:
    """An encoder for the ranks of a vocabulary and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([c])] for c in range(256)]
        #: The rank of two neighbouring tokens' bytes, for every cut of every token into two.
        self.pairs = {ranks[t[:k]] << 20 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.joins: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.segments: dict[bytes, tuple[int, ...]] = {}
        self.done: dict[str, bytes] = {}
        self.chunks = Chunks(lambda chunks: [self._chunk(c) if c else b"" for c in chunks], 4, CHUNKS, GROUP_BYTES)

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """Some bytes, merged from single ones by lowest rank, leftmost first."""
        parts = [self.single[c] for c in data]
        if len(parts) > 48:
            return self._merged_by_heap(parts)
        pair = self.pairs.get
        ranks = [pair(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [best]
            del ranks[at]
            if at:
                ranks[at - 1] = pair(parts[at - 1] << 20 | best, NEVER)
            if at < len(ranks):
                ranks[at] = pair(best << 20 | parts[at + 1], NEVER)
        return tuple(parts)

    def _merged_by_heap(self, parts: list[int]) -> tuple[int, ...]:
        """The same in O(n log n): candidate pairs by (rank, place); one whose tokens have changed is stale."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.pairs.get(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(heap, (rank, i, j, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] != j or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple([p for p in parts if p >= 0])

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """A few tokens' bytes, encoded anew."""
        got = self.joins.get(tokens)
        if got is None:
            got = self._merged(b"".join([self.bytes[t] for t in tokens]))
            if len(tokens) <= 4:
                if got == tokens:
                    got = tokens  # one tuple for both
                if len(self.joins) >= MEMORY:
                    self.joins.clear()
                self.joins[tokens] = got
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The tokens of two neighbouring segments' bytes."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self._window(left[-a:] + right[:b])
            left_holds = a == len(left) or window[0] == left[-a]
            right_holds = b == len(right) or window[-1] == right[b - 1]
            if left_holds and right_holds:
                return left[: len(left) - a] + window + right[b:]
            if not left_holds:
                a = min(2 * a, len(left))
            if not right_holds:
                b = min(2 * b, len(right))

    def segment(self, data: bytes) -> tuple[int, ...]:
        """The tokens of some bytes, by halves."""
        if len(data) <= 1:
            return (self.ranks[data],) if data else ()
        got = self.segments.get(data)
        if got is None:
            half = len(data) // 2
            got = self.join(self.segment(data[:half]), self.segment(data[half:]))
            if len(data) <= SEGMENT_BYTES:
                if len(self.segments) >= MEMORY:
                    self.segments.clear()
                self.segments[data] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk[1:].isalpha() and chunk[0] == " ":
            return self._encoded(chunk.encode())  # remembered as a chunk
        return b"".join([self._piece(p) for p in self.pieces(chunk)])

    def _piece(self, piece: str) -> bytes:
        got = self.done.get(piece)
        if got is None:
            data = piece.encode()
            got = self._encoded(data)
            if len(data) <= PIECE_BYTES:
                if len(self.done) >= MEMORY:
                    self.done.clear()
                self.done[piece] = got
        return got

    def _encoded(self, data: bytes) -> bytes:
        """The ids of a piece's bytes."""
        whole = self.ranks.get(data)
        return array("I", self.segment(data) if whole is None else (whole,)).tobytes()

    def encode_all(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self.chunks.texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids: halves decoded, then concatenated."""
        if len(ids) > 4096:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes.__getitem__, ids))


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_ready: dict[str, Bpe] = {}


def encoder(path: str) -> Bpe:
    """One encoder for each worker and vocabulary file."""
    if path not in _ready:
        import public_tokenizers

        _ready[path] = Bpe(ranks_of(path), public_tokenizers.PATTERN)
    return _ready[path]


def encoded(docs: DataFrame, path: str, keep_ids: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """For each (doc_id, text): doc_id, n_tokens, the digests of the ids and of the decoded bytes, ids if asked for
    (binary, little-endian unsigned 32 bits), and the ``carried`` columns (longs) as they are."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for ids in bpe.encode_all(batch.column(1)):
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist())).hexdigest(), ids.tobytes() if keep_ids else b""))
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.string(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays([*columns[: 5 if keep_ids else 4], *batch.columns[2:]], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids + "".join(f", {c} long" for c in carried)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), no_null("text").alias("text"), *[F.col(c).cast("long").alias(c) for c in carried]).mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    return encoded(table(spark, sf_dir, "documents", ["doc_id", "text"]), vocabulary("byte_bpe_multi_50k.tiktoken"))
