"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits differ in at most three
bytes, so they share at least five positional bytes: the count that a pair's tally must reach. Posting lists of single
bytes hold a 256th of all fingerprints, which makes tallies quadratic. Of five shared positions at least three lie in the
same half, so a pair also meets under three positional bytes of one half: the index posts a fingerprint eight times, under
every three of four positions (24 bits). For each pair that meets, the shared positional bytes are tallied; pairs that reach
five are retained and verified by the bits that differ.

Only distinct fingerprints are indexed, so a group of copies is one entry. Members of lists longer than LONG are posted
under every set of five positions instead (56 lists of 40 bits), where only pairs that reach the tally meet, and which have at
most 2^24 members, because 24 bits of a member are free: that bounds what meets in one task. In a short list all pairs are
tallied. In a longer one a search from member to member yields the links of a spanning forest, at most one for each member,
so a dense group never becomes a quadratic number of rows; beyond 4,096 members the search looks up each member's 2,324
possible neighbours in a table of the free bits and needs time in proportion to the list.

Documents that share a fingerprint meet in joins on it alone, which AQE splits where one is hot.

Edge cases: a null text is empty; texts without words have fingerprint 0 and are linked like any other; fewer than three
words make one shingle; ids that are null belong to their component but never name it (component_id is null if all are);
repeated rows are in one component; very long texts are hashed in pieces of bounded size; ties for the least doc_id go to the
least text hash; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.common import no_null, table, written
from tactus.llm.components import stars

WIDTH = 3
SEED = 42
MOST_BITS = 3
#: Shared positional bytes that a pair within MOST_BITS has at least.
LEAST_SHARED = 8 - MOST_BITS
LISTS = list(combinations(range(8), LEAST_SHARED))
#: Any five of eight positions hold one of these.
BLOCKS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
#: The most members of a list under BLOCKS.
LONG = 4096

ALL_PAIRS = 24
BY_TABLE = 4096
_PART = 1 << 16


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of word 3-shingles, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    if len(words) > WIDTH:
        starts, ends = starts[: 1 - WIDTH], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _PART):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) of each row's text: fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["key", "fp"])

    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie")).alias("key"), no_null("text").alias("text"))
    return rows.mapInArrow(run, "key struct<doc_id: long, tie: long>, fp long").select("key.doc_id", "key.tie", "fp")


def postings(distinct: DataFrame, lists: list[tuple[int, ...]] = BLOCKS) -> DataFrame:
    """(key, fp): the list's number above the bytes at its positions, for each list of a fingerprint."""

    def key(number: int, places: tuple[int, ...]) -> Column:
        out = F.lit(number << 8 * len(places)).cast("long")
        for to, at in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * at).bitwiseAND(F.lit(255).cast("long")), 8 * to))
        return out

    return distinct.select("fp", F.explode(F.array(*[key(n, p) for n, p in enumerate(lists)])).alias("key"))


def _first(lists: list[tuple[int, ...]]) -> np.ndarray:
    """For each set of equal bytes (a bit each) the first list that holds such pairs: a pair is reported there only."""
    return np.array([next((n for n, p in enumerate(lists) if all(m >> i & 1 for i in p)), 99) for m in range(256)], np.int64)


_MASKS = np.array([sum(1 << i for i in c) for r in range(1, MOST_BITS + 1) for c in combinations(range(8 * MOST_BITS), r)], np.int64)


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """For each xor of two fingerprints the set of equal bytes."""
    same = x.view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(same, axis=1, bitorder="little")[:, 0]


def _near(x: np.ndarray) -> np.ndarray:
    """For each xor of a pair that met: whether the tally of its shared positional bytes suffices, and then its bits do."""
    retained = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED
    retained[retained] = np.bitwise_count(x[retained]) <= MOST_BITS
    return retained


def _forest(fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the members of one list within MOST_BITS, one for each member but the first of a group."""
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _near(fp[rest] ^ fp[at])
            if near.any():
                for other in rest[near]:
                    yield at, other
                front += rest[near].tolist()
                rest = rest[~near]


def _forest_by_table(fp: np.ndarray, number: int) -> Iterator[tuple[int, int]]:
    """The same for a long list: neighbours by lookup of the 24 free bits."""
    free = np.zeros(len(fp), np.int64)
    for to, at in enumerate(i for i in range(8) if i not in LISTS[number]):
        free |= ((fp >> np.uint64(8 * at)) & np.uint64(255)).astype(np.int64) << 8 * to
    slot = np.full(1 << 8 * MOST_BITS, -1, np.int32)
    slot[free] = np.arange(len(fp))
    for first in range(len(fp)):
        if slot[free[first]] != first:
            continue
        slot[free[first]] = -1
        front = [first]
        while front:
            at = front.pop()
            near = slot[free[at] ^ _MASKS]
            near = near[near >= 0]
            slot[free[near]] = -1
            for other in near.tolist():
                yield at, other
            front += near.tolist()


def _links(key: np.ndarray, fp: np.ndarray, lists: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The links inside whole lists, sorted by key; fp unsigned and distinct in a list."""
    first, bits = _first(lists), 8 * len(lists[0])
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(bounds)
    left, right = [], []
    short = np.repeat(sizes <= ALL_PAIRS, sizes)
    for step in range(1, min(ALL_PAIRS, int(sizes.max(initial=0)))):
        at = np.flatnonzero((key[step:] == key[:-step]) & short[step:])
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        near = _near(x)
        at, x = at[near], x[near]
        own = first[_equal_bytes(x)] == key[at] >> bits
        left.append(fp[at[own]])
        right.append(fp[at[own] + step])
    for n in np.flatnonzero(sizes > ALL_PAIRS):
        own = fp[bounds[n] : bounds[n + 1]]
        found = _forest(own) if len(own) <= BY_TABLE else _forest_by_table(own, int(key[bounds[n]] >> bits))
        pairs = np.array(list(found), np.int64).reshape(-1, 2)
        left.append(own[pairs[:, 0]])
        right.append(own[pairs[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _met(posted: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """(a, b), a < b: the links inside the lists of ``posted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one list that may go on, but for the last batch

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in _links(key, fp, lists))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if key[-1] != (held[0][0][0] if held else key[0]):
                cut = int(np.searchsorted(key, key[-1]))
                held.append((key[:cut], fp[:cut]))
                yield out(*map(np.concatenate, zip(*held)))
                held, key, fp = [], key[cut:], fp[cut:]
            held.append((key, fp))
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    return posted.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: links that connect exactly the fingerprints that chains of three bits connect."""
    posted = postings(distinct)
    long = written(posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("key"), "long-lists")
    if not long.take(1):
        return _met(posted, BLOCKS)
    members = posted.join(long, "key", "left_semi").select("fp").distinct()
    return _met(posted.join(long, "key", "left_anti"), BLOCKS).union(_met(postings(members, LISTS), LISTS))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp, root, component_id) of all documents: tie is a hash of the text, root the component's least
    fingerprint."""
    prints = written(fingerprints(docs), "fingerprints")
    lows = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-lows")
    star = stars(links(lows.select("fp")))
    rooted = lows.join(star.select(F.col("b").alias("fp"), F.col("a").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root"), "fp")


def _row_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.xxhash64("text"))


def one_of_each(docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id, null last, then the least text hash.

    ``parts`` has doc_id, tie and root of every row, of ``components`` here (the default) or in tactus.llm.nearcopies.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    first = (components(docs) if parts is None else parts).groupBy("root").agg(best.alias("best")).select(F.concat_ws(":", F.coalesce(F.col("best.doc_id").cast("string"), F.lit("null")), F.col("best.tie")).alias("_key"))
    keep = written(first.distinct(), "kept-rows")
    rows = docs.select(_row_key().alias("_key"), F.struct(*docs.columns).alias("_row")).join(keep, "_key")
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # rows that repeat wholly
    return rows.withColumn("_again", again).where("_again = 1").select("_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    parts = components(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
