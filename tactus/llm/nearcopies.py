"""Near copies by the Jaccard similarity of word shingles: exact, by prefix filtering and a check of the whole sets.

A text is the set of its shingles' hashes, and texts with the same words are one set. All sets are sorted by one order of
shingles, frequent ones of a sample last. Two sets whose similarity is at least LEAST share a shingle among the first
n - ceil(LEAST * n) + 1 of each, so only these are posted; a pair that cannot reach LEAST by its sizes and places is
dropped, and every other pair is checked on the whole sets.

A pair inside one component needs no check. In lists of more than ALL_PAIRS members neighbours are checked
first, by another order in each of ROUNDS rounds; then all pairs whose members are still in different components. A dense
group is joined by its neighbours, so its pairs never become rows, and no pair that could join two components is left out.

Edge cases: a null text is empty; texts without words are one set; fewer words than WIDTH make one shingle; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import no_null, written
from tactus.llm.components import stars

WIDTH = 5
#: The least similarity as a fraction.
LEAST = (4, 5)
SEED = 42
ALL_PAIRS = 24
ROUNDS = 2
#: A shingle that so many texts of one SAMPLE-th hold goes last; at most MOST_LATE do. The order bears on speed alone.
SAMPLE, LATE, MOST_LATE = 16, 16, 100_000


def shingles(text: str, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """The hash of a text's words, and the sorted hashes of its distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        grams = [joined] if words else []
    else:
        grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64).view(np.int64)
    return int(np.uint64(xxh64_intdigest(joined, SEED + 1)).view(np.int64)), np.unique(hashes)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tie, id, grams) of each row: tie as in simhash.fingerprints, id stands for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(x.as_py(), width) for x in part.column(1)]
                grams = pa.array([g for _, g in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i for i, _ in found], pa.int64()), grams], names=["key", "id", "grams"])

    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie")).alias("key"), no_null("text").alias("text"))
    out = rows.mapInArrow(run, "key struct<doc_id: long, tie: long>, id long, grams array<long>")
    return out.select("key.doc_id", "key.tie", "id", "grams")


def _late(distinct: DataFrame) -> np.ndarray:
    sample = distinct.where(F.pmod(F.col("id"), F.lit(SAMPLE)) == 0).select(F.explode("grams").alias("g"))
    often = sample.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LATE).orderBy(F.desc("n"), "g").limit(MOST_LATE)
    return np.sort(np.array([r["g"] for r in often.collect()], np.int64))


def postings(distinct: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(g, id, n, at): the first shingles of each set, the set's size and the shingle's place in it."""
    late, (num, den) = _late(distinct), least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = grams.values.to_numpy()
                if not len(g):
                    continue
                n = len(g)
                g = g[np.lexsort([g, np.isin(g, late)])][: n - (num * n + den - 1) // den + 1]
                one = np.ones(len(g), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, own * one, n * one, np.arange(len(g)))], names=["g", "id", "n", "at"])

    return distinct.select("id", "grams").mapInArrow(run, "g long, id long, n long, at long")


def _close(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether pairs are of two components and can reach the least similarity if this shingle is the first they share."""
    (num, den), n, at = least, rows["n"], rows["at"]
    most = np.minimum(n[i] - at[i], n[j] - at[j])
    return (rows["root"][i] != rows["root"][j]) & (most * (num + den) >= num * (n[i] + n[j]))


def _short(rows: dict[str, np.ndarray], short: np.ndarray, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the short lists; ``rows`` are sorted by list."""
    for step in range(1, ALL_PAIRS):
        i = np.flatnonzero((rows["g"][step:] == rows["g"][:-step]) & short[step:])
        if not len(i):
            break
        i = i[_close(rows, i, i + step, least)]
        yield rows["id"][i], rows["id"][i + step]


def _long(rows: dict[str, np.ndarray], turn: int | None, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one long list to be checked: neighbours by the order of ``turn``, or all of two components."""
    own = rows["id"]
    if turn is not None:
        order = np.argsort(own * np.int64(2 * turn + 1) ^ np.int64(turn * 0x5DEECE66D))
        i, j = order[:-1], order[1:]
        keep = _close(rows, i, j, least)
        yield own[i[keep]], own[j[keep]]
        return
    _, label, sizes = np.unique(rows["root"], return_inverse=True, return_counts=True)
    largest = label == np.argmax(sizes)  # its members last: they meet only others
    order = np.argsort(largest, kind="stable")
    for k in range(int((~largest).sum())):
        j = order[k + 1 :]
        j = j[_close(rows, np.full(len(j), order[k]), j, least)]
        if len(j):
            yield np.full(len(j), own[order[k]]), own[j]


def candidates(posted: DataFrame, turn: int | None, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b), a < b, distinct: pairs of ``posted`` (g, id, n, at, root) to be checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "id", "n", "at", "root"]
        kept = {c: np.zeros(0, np.int64) for c in names}

        def out(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            bounds = np.flatnonzero(np.concatenate([[True], rows["g"][1:] != rows["g"][:-1], [True]]))
            sizes = np.diff(bounds)
            found = [_short(rows, np.repeat(sizes <= ALL_PAIRS, sizes), least)]
            found += [_long({c: v[bounds[k] : bounds[k + 1]] for c, v in rows.items()}, turn, least) for k in np.flatnonzero(sizes > ALL_PAIRS)]
            for a, b in chain.from_iterable(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            kept = {c: np.concatenate([kept[c], batch.column(k).to_numpy()]) for k, c in enumerate(names)}
            if len(kept["g"]) and kept["g"][0] != kept["g"][-1]:  # the last list may go on
                cut = int(np.searchsorted(kept["g"], kept["g"][-1]))
                yield from out({c: v[:cut] for c, v in kept.items()})
                kept = {c: v[cut:] for c, v in kept.items()}
        if len(kept["g"]):
            yield from out(kept)

    return posted.select("g", "id", "n", "at", "root").repartition("g").sortWithinPartitions("g", "id").mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, distinct: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs whose whole sets reach the least similarity."""
    num, den = least
    left = distinct.select(F.col("id").alias("a"), F.col("grams").alias("_a"))
    right = distinct.select(F.col("id").alias("b"), F.col("grams").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(both * (num + den) >= num * (F.size("_a") + F.size("_b"))).select("a", "b")


def components(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, tie, root) of all rows: root names the component of near copies."""
    rows = written(sets(docs, width), "shingles")
    distinct = written(rows.groupBy("id").agg(F.first("grams").alias("grams")), "shingle-sets")
    posted = written(postings(distinct, least), "postings")
    frequent = posted.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > ALL_PAIRS).select("g")
    near = written(checked(candidates(posted.withColumn("root", F.col("id")), 0, least), distinct, least), "near-pairs")
    star = stars(near)
    long = written(posted.join(frequent, "g", "left_semi"), "long-lists")
    for turn in [*range(1, ROUNDS), None]:
        if not long.take(1):
            break
        rooted = long.join(star.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
        more = written(checked(candidates(rooted, turn, least), distinct, least), "near-pairs")
        if more.take(1):
            star = stars(star.select("a", "b").union(more))
    return rows.select("doc_id", "tie", "id").join(star.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left").select("doc_id", "tie", F.coalesce("root", "id").alias("root"))
