"""Token ids in files: frequency-ranked, byte-aligned variable-length code with separate control bytes.

All documents are tokenized once and the ids kept as 16 or 32 bit arrays in the shared folder; each task counts its ids
as it goes, one row for a task. An id's rank by falling count is what the files hold, so frequent ids take one byte. A value takes 1 to 4
bytes; its length less one stands in two bits of a control byte for four values, apart from the data bytes. The reader
looks control bytes up in a table of lengths, whose sums say where each value begins.

A file holds the blocks of a contiguous range of ascending doc_ids, written through Spark's own committer, so a task
that runs twice leaves one file, and any store that Spark knows will do. A block (a row of the file) has: start (ids of
the file before it), doc_ids and lengths of its documents, n, control and data. The rank table lies beside the blocks.

Edge cases: a null text is empty and has the end id only; the string of an added token (such as an end mark) in a text is
that token, as the library has it; very long texts make a block of their own; other columns, whatever their names, are not read; null doc_ids come first; repeated doc_ids stand by a hash of
their ids; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.chunks import Pieces, groups
from tactus.llm.common import no_null, scratch, table, vocabulary, written

END_ID = 2
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16

#: For each control byte the lengths of its four values, a byte each.
LENGTHS = np.array([[1 + (c >> shift & 3) for shift in (0, 2, 4, 6)] for c in range(256)], np.uint8).view("<u4").reshape(-1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    longer = [np.flatnonzero(v > (1 << 8 * k) - 1) for k in (1, 2, 3)]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    for at in longer:
        codes[at] += 1
    starts = np.cumsum(codes[: len(v)], dtype=np.int64) - codes[: len(v)] + np.arange(len(v))
    data = np.empty(len(v) + sum(map(len, longer)), np.uint8)
    data[starts] = v.view(np.uint8)[::4]
    for k, at in enumerate(longer, 1):
        data[starts[at] + k] = v.view(np.uint8)[k::4][at]
    four = codes.view("<u4")
    return (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack``."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].view(np.uint8)[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(length, dtype=np.int64) - length
    out = raw[starts].astype("<u4")
    for k in range(1, int(length.max(initial=1))):
        at = np.flatnonzero(length > k)
        out[at] |= raw[starts[at] + k].astype("<u4") << np.uint32(8 * k)
    return out


#: Chunks that go to the tokenizer as one text.
TOGETHER = 256


class Tokens:
    """The chunk encoder of a tokenizer file: ids as little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # byte-level tokens have a character for each byte
        self.chunks = Pieces(self.encode_many, self.width)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids. Chunks of a space and a sign may follow one another in one text, as no token crosses
        their start; the tokens' byte lengths tell which are whose."""
        out = [b""] * len(chunks)
        joint = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        alone = sorted(set(range(len(chunks))).difference(joint))
        for i, ids in zip(alone, self._encode([chunks[i] for i in alone])):
            out[i] = ids.tobytes()
        groups = [joint[i : i + TOGETHER] for i in range(0, len(joint), TOGETHER)]
        for group, ids in zip(groups, self._encode(["".join([chunks[i] for i in g]) for g in groups])):
            ends = np.cumsum([len(chunks[i].encode()) for i in group])
            cuts = (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1) * self.width
            data, start = ids.tobytes(), 0
            for i, cut in zip(group, cuts.tolist()):
                out[i] = data[start:cut]
                start = cut
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts, with the end id behind each. A text that holds the string of an added token goes
        to the library whole, as the library looks for those before it cuts."""
        end = END_ID.to_bytes(self.width, "little")
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self.chunks.group(texts, end)
        plain, bounds = self.chunks.group(pc.if_else(pa.array(special), "", texts), end)
        parts = [plain[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.concatenate([self._encode([texts[i].as_py()])[0], parts[i]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ready: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """One encoder for each worker and tokenizer file."""
    if path not in _ready:
        _ready[path] = Tokens(path)
    return _ready[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, width, ids, counts): each text's ids with the end id, as little-endian integers of ``width`` bytes; and one
    row for each task with how often it has each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        total = np.zeros(len(tokens.size), np.int64)
        for batch in batches:
            done = 0
            for texts in groups(batch.column(1)):
                ids, bounds = tokens.ids(texts)
                total += np.bincount(ids, minlength=len(total))
                n = len(texts)
                binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * tokens.width), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array([tokens.width] * n, pa.int32()), binary, pa.nulls(n, pa.binary())], names=names)
                done += n
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "width", "ids", "counts"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null("text").alias("text")).mapInArrow(run, "doc_id long, width int, ids binary, counts binary")


def _read(width: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the row of counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                total = np.frombuffer(counts.as_buffer(), np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Writes the files of (doc_id, text) below ``path`` and returns it."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer), "tokens", "zstd")
    ranked = id_counts(tokens).orderBy(F.desc("n"), "id").select("id").collect()  # at most the vocabulary
    by_rank = np.array([r["id"] for r in ranked], np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, block = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal start, block
            values = np.concatenate([x for _, x in held])
            control, data = pack(values)
            row = {"shard": shard, "block": block, "start": start, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held], "n": len(values), "control": control, "data": data}
            start, block = start + len(values), block + 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        size = 0
        for batch in batches:
            for doc, width, ids in zip(batch.column(0), batch.column(1), batch.column(2)):
                held.append((doc.as_py(), shared.value[_read(width.as_py(), ids.as_buffer())]))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield close()
                    size = 0
        if held:
            yield close()

    ordered = tokens.where("counts is null").withColumn("_h", F.xxhash64("ids")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "ids")
    ordered.select("doc_id", "width", "ids").mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return path


BLOCK_DDL = "shard int, block int, start long, doc_ids array<long>, lengths array<int>, n int, control binary, data binary"
BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n", pa.int32()), ("control", pa.binary()), ("data", pa.binary())]
)


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, and ids if asked for, from the files."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()  # the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shared.value[unpack(row["control"], row["data"], row["n"])].astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                columns = [
                    pa.array([row["shard"]] * len(parts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    *([pa.array([p.tobytes() for p in parts], pa.binary())] if keep_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = blocks.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(files), "shard").withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")  # one row for each file


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in ascending doc_id order and read back."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return read(spark, write(docs, scratch(spark, "token-files"), vocabulary("byte_bpe_50k.json")))
