"""Exact top-k by inner product with two cover trees.

Equal vectors become one entry with their k + 1 smallest ids (a query excludes itself, so more are never needed). A cover
tree's levels halve: the centres of a level lie farther apart than its radius, every point is within that radius of one,
and a level's centres are also those of the level below. Farthest-first traversal yields all levels at once, as its gaps
never grow. A node keeps the distance to its farthest member as covering radius.

The top of one tree, built over about SAMPLE entries by a hash, gives centres; every entry and every query goes to its
nearest one, and a centre's entries are dealt to parts of about PART. A query is first searched in the parts of its own
centre. With the kth score found there it goes only to the parts of those centres whose covering radius lets a product
reach it, so what is sent follows from the bounds and not from the number of parts.

In a part the queries come in groups, each with a cover tree of its own, and pairs of nodes are searched together. A pair
is pruned once

    centre_q . centre_x + r_q |centre_x| + r_x |centre_q| + r_q r_x

which no product inside can exceed, is below the worst kth score of the query node's group. Equal scores are never
pruned, as ties go to smaller ids. Leaves are scored exactly, in double precision while products stay below 2^53 and
in Python integers beyond; a score beyond 64 bits is the nearest number of 64 bits.

A task holds one part and one group of queries, whatever the tables' sizes; the driver gets the sample and a few numbers
for each of its centres.

Edge cases: null vectors and those with null or non-finite components, also after scaling, take no part; vectors of other
lengths are never compared; repeated ids count once, and an id with several vectors scores by the best of them; fewer
than k candidates give fewer rows; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tactus.llm.common import table, written

SCALE = 256
QUERY_EVERY = 50
K = 5
PART = 8192
GROUP = 2048
#: Centres of a tree for each so many points, one more; what lies below them are leaves.
LEAF = 48
#: About so many entries (at most twice as many) are what the top of the tree is built over, and the most centres taken from it.
SAMPLE = 8192
MOST_CENTRES = 1024
LIMIT = 2**63 - 1


@dataclass
class Node:
    members: np.ndarray  # rows below it
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self.norm = float(np.linalg.norm(self.centre))
        if self.children:
            self.centres = np.array([c.centre for c in self.children])
            self.radii, self.norms = (np.array([getattr(c, x) for c in self.children]) for x in ("radius", "norm"))


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def nets(points: np.ndarray, most: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(radius, centres, nearest) of each level from the top: rows that are centres, and for each point the place of its
    nearest one. With ``most`` centres the last level ends early: it is a net of a radius between two levels."""
    centres, nearest = [0], np.zeros(len(points), np.int64)
    least = _away(points, points[0])
    radius = float(least.max())
    out = [(radius, np.array(centres), nearest.copy())]
    while np.isfinite(radius) and least.max() > 0 and len(centres) < most:
        radius /= 2
        before = len(centres)
        while len(centres) < most and least.max() > radius:
            far = int(least.argmax())
            away = _away(points, points[far])
            nearest[away < least] = len(centres)
            least = np.minimum(least, away)
            centres.append(far)
        if len(centres) > before:
            out.append((radius if least.max() <= radius else float(least.max()), np.array(centres), nearest.copy()))
    return out


def cover_tree(points: np.ndarray) -> Node:
    """A tree over the rows of ``points``."""
    levels = nets(points, 1 + len(points) // LEAF)

    def node(centre: int, members: np.ndarray, children: list[Node]) -> Node:
        return Node(members, points[centre], float(_away(points[members], points[centre]).max()), children)

    _, centres, nearest = levels[-1]
    order = np.argsort(nearest, kind="stable")
    bounds = np.searchsorted(nearest[order], np.arange(len(centres) + 1))
    nodes = [node(c, order[a:b] if b > a else np.array([c]), []) for c, a, b in zip(centres, bounds, bounds[1:])]
    for _, above, nearest in reversed(levels[:-1]):
        own: list[list[Node]] = [[] for _ in above]
        for place, child in enumerate(nodes):
            own[place if place < len(above) else nearest[centres[place]]].append(child)
        nodes = [c[0] if len(c) == 1 else node(centre, np.concatenate([x.members for x in c]), c) for centre, c in zip(above, own)]
    return nodes[0]


class Search:
    """The best ``k`` entries for a group of queries: scores falling, then ids rising. Entries below a query's ``floor``
    need not be found; scores beyond ``limit`` on either side count as it."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None, limit: int | None = None):
        self.queries, self.k, self.tree, self.limit = queries, k, cover_tree(queries), limit
        self.scores = np.full((len(queries), k), -np.inf)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.ids = np.full((len(queries), k), LIMIT)
        self.at = np.full((len(queries), k), -1)

    def run(self, points: np.ndarray, ids: np.ndarray, tree: Node) -> None:
        self.points, self.point_ids = points, ids
        big = np.abs(self.queries).max(initial=0) * np.abs(points).max(initial=0) * points.shape[1]
        self.exact_floats = big < 2**53
        self._pair(self.tree, tree, np.inf)

    def _within(self, score: int) -> int:
        return score if self.limit is None else max(-self.limit, min(self.limit, score))

    def _least(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1].astype(float), self.floor[rows])

    def _pair(self, q: Node, x: Node, most: float) -> None:
        if most + 0.5 + 1e-9 * abs(most) < self._least(q.members).min():
            return
        if not q.children and not x.children:
            self._leaves(q.members, x.members)
        elif x.children and (x.radius >= q.radius or not q.children):
            bounds = x.centres @ q.centre + q.radius * x.norms + x.radii * (q.norm + q.radius)
            for i in np.argsort(-bounds, kind="stable"):
                self._pair(q, x.children[i], float(bounds[i]))
        else:
            bounds = q.centres @ x.centre + x.radius * q.norms + q.radii * (x.norm + x.radius)
            for child, bound in zip(q.children, bounds.tolist()):
                self._pair(child, x, bound)

    def _leaves(self, rows: np.ndarray, members: np.ndarray) -> None:
        if self.exact_floats:
            scores = self.queries[rows] @ self.points[members].T
        else:
            whole = [[int(v) for v in p] for p in self.points[members]]
            scores = np.array([[self._within(sum(int(a) * b for a, b in zip(q, p))) for p in whole] for q in self.queries[rows]], object)
        # a floor is a float: beyond 2^53 it may be a little above the score it stands for
        better = (scores.astype(float) >= self._least(rows)[:, None] * (1 if self.exact_floats else 1 - 1e-12 * np.sign(self._least(rows))[:, None])).any(axis=1)
        if not better.any():
            return
        rows, scores = rows[better], scores[better]
        n = len(rows)
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(self.point_ids[members], (n, len(members)))], axis=1)
        all_at = np.concatenate([self.at[rows], np.broadcast_to(members, (n, len(members)))], axis=1)
        best = np.lexsort((all_ids, -all_scores.astype(float)), axis=1)[:, : self.k]
        if not self.exact_floats:  # floats could merge different integers
            best = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k] for s, i in zip(all_scores, all_ids)])
            self.scores = self.scores.astype(object)
        for own, new in ((self.scores, all_scores), (self.ids, all_ids), (self.at, all_at)):
            own[rows] = np.take_along_axis(new, best, axis=1)


def usable(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors with components floor(scale * x) as doubles."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double") + F.lit(0.0)).otherwise(y)  # beyond, all doubles are whole

    out = rows.where(usable(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col(vector), whole).alias("v"))
    return out.where(usable(F.col("v")))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 smallest ids. The limit of ranks works before the shuffle, so a
    vector that most rows share sends k + 1 rows of each task."""
    order = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Centres:
    """The top of the tree: centres of each length of vectors, and what is known of the entries nearest to each."""

    def __init__(self, sample: list[np.ndarray], most: int):
        self.by_length: dict[int, tuple[int, np.ndarray]] = {}  # first number, centres
        at = 0
        for n in sorted({len(v) for v in sample}):
            own = np.array([v for v in sample if len(v) == n])
            chosen = own[nets(own, max(1, most * len(own) // max(1, len(sample))))[-1][1]]
            self.by_length[n] = at, chosen
            at += len(chosen)
        self.parts, self.radius = np.ones(at + 1, np.int64), np.zeros(at + 1)

    def home(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centre, and the distance; the last number for lengths without centres."""
        out, away = np.full(len(vectors), len(self.radius) - 1), np.zeros(len(vectors))
        sizes = np.array([len(v) for v in vectors])
        for n in set(sizes.tolist()) & set(self.by_length):
            first, centres = self.by_length[n]
            rows = np.flatnonzero(sizes == n)
            own = np.array([vectors[i] for i in rows])
            square = (centres**2).sum(axis=1)
            for a in range(0, len(rows), GROUP):
                at = np.argmin(square - 2 * own[a : a + GROUP] @ centres.T, axis=1)
                out[rows[a : a + GROUP]] = first + at
                away[rows[a : a + GROUP]] = _away(own[a : a + GROUP], centres[at])
        return out, away

    def reached(self, vector: np.ndarray, floor: float, home: int) -> list[int]:
        """The centres but ``home`` whose entries can score ``floor`` with the vector."""
        if len(vector) not in self.by_length:
            return []
        first, centres = self.by_length[len(vector)]
        most = centres @ vector + self.radius[first : first + len(centres)] * float(np.linalg.norm(vector)) * (1 + 1e-9)
        # written so that bounds that are no numbers pass
        return [first + int(i) for i in np.flatnonzero(~(most + 0.5 + 1e-9 * np.abs(most) < floor)) if first + i != home]

    def of(self, home: int) -> range:
        """The parts of a centre."""
        return range(int(self.first[home]), int(self.first[home] + self.parts[home]))

    def dealt(self, rows: list) -> None:
        """Takes (home, n, away) of each centre that has entries."""
        for r in rows:
            self.parts[r["home"]], self.radius[r["home"]] = max(1, -(-r["n"] // PART)), r["away"]
        self.first = np.cumsum(self.parts) - self.parts


KEY = pa.struct([("low", pa.int64()), ("hash", pa.int64())])
OUT = pa.schema([("key", KEY), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])
MET = "part long, kind int, ids array<long>, v array<double>, key struct<low: long, hash: long>, floor double"


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy() for v in column]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple] = []
        queries: list[tuple] = []
        held: dict[int, tuple] = {}  # by length: points, first ids, ids, tree
        part = None

        def answers() -> Iterator[pa.RecordBatch]:
            for dim in {len(v) for _, v, _ in queries}:
                if dim not in held:
                    continue
                points, first, ids, tree = held[dim]
                own = [(key, v, floor) for key, v, floor in queries if len(v) == dim]
                search = Search(np.array([v for _, v, _ in own]), k + 1, np.array([-np.inf if f is None else f for _, _, f in own]), LIMIT)
                search.run(points, first, tree)
                out = [(key, int(s), ids[a]) for (key, _, _), at, scores in zip(own, search.at, search.scores) for a, s in zip(at, scores) if a >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(OUT.types)], schema=OUT)
            queries.clear()

        def index() -> None:
            held.clear()
            for dim in {len(v) for v, _ in data}:
                own = [(v, ids) for v, ids in data if len(v) == dim]
                points = np.array([v for v, _ in own])
                held[dim] = points, np.array([ids[0] for _, ids in own], np.int64), [ids for _, ids in own], cover_tree(points)
            data.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for p, kind, ids, key, floor, v in zip(*columns, _vectors(batch.column(3))):
                if p != part:
                    yield from answers()
                    data.clear()
                    held.clear()
                    part = p
                if kind == 0:
                    data.append((v, ids))
                    continue
                if data:
                    index()
                queries.append((key, v, floor))
                if len(queries) >= GROUP:
                    yield from answers()
        yield from answers()

    return run


def _homes(rows: DataFrame, centres: Centres) -> DataFrame:
    """``rows`` with home, their vector v's nearest centre, and away, the distance."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, away = shared.value.home(_vectors(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(away, pa.float64())], names=[*batch.schema.names, "home", "away"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("home", IntegerType()), StructField("away", DoubleType())]))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``rows`` but itself for each of ``queries``, both (vec_id, v)."""
    entries = written(_entries(rows, k), "entries")
    size = entries.count()
    some = entries.select("v").where(F.pmod(F.xxhash64("v"), F.lit(-(-size // SAMPLE) or 1)) == 0)  # about SAMPLE rows
    sample = [np.array(r["v"]) for r in some.limit(2 * SAMPLE).collect()]
    centres = Centres(sample, max(1, min(MOST_CENTRES, -(-size // PART))))
    homed = written(_homes(entries, centres), "entry-homes")
    centres.dealt(homed.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect())  # one row for each centre
    asked = queries.select("vec_id", F.col("v"), F.xxhash64("v").alias("hash"))
    low = asked.groupBy("v", "hash").agg(F.min("vec_id").alias("low")).select("v", F.struct("low", "hash").alias("key"))
    low = written(_homes(low, centres).drop("away"), "queries")
    own = F.create_map(*[F.lit(int(x)) for h in range(len(centres.parts)) for x in (h, centres.first[h])])
    many = F.create_map(*[F.lit(int(x)) for h in range(len(centres.parts)) for x in (h, centres.parts[h])])
    dealt = own[F.col("home")] + F.pmod(F.xxhash64("v"), many[F.col("home")])
    data = homed.select(dealt.cast("long").alias("part"), F.lit(0).alias("kind"), "ids", "v", F.lit(None).cast("struct<low: long, hash: long>").alias("key"), F.lit(None).cast("double").alias("floor"))
    shared, parts = rows.sparkSession.sparkContext.broadcast(centres), int(centres.parts.sum())

    def sent(others: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = shared.value
            for batch in batches:
                for key, v, home, floor in zip(batch.column("key").to_pylist(), _vectors(batch.column("v")), batch.column("home").to_pylist(), batch.column("floor").to_pylist()):
                    to = [p for h in (top.reached(v, -np.inf if floor is None else floor, home) if others else [home]) for p in top.of(h)]
                    n = len(to)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([1] * n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.array([v] * n, pa.list_(pa.float64())), pa.array([key] * n, KEY), pa.array([floor] * n, pa.float64())], names=["part", "kind", "ids", "v", "key", "floor"])

        return run

    by_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")

    def met(asking: DataFrame, others: bool) -> DataFrame:
        both = data.union(asking.select("key", "v", "home", "floor").mapInArrow(sent(others), MET))
        pairs = both.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_search(k), "key struct<low: long, hash: long>, score long, ids array<long>")
        return pairs.select("key", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= k + 1)

    near = written(met(low.withColumn("floor", F.lit(None).cast("double")), False), "near")
    floors = near.where(F.col("r") == k + 1).select("key", F.col("score").cast("double").alias("floor"))
    found = near
    if len(centres.parts) > 2:  # the last number is for lengths without centres
        found = near.union(met(low.join(floors, "key", "left"), True))
    found = found.withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= k + 1).drop("r")
    ids = asked.join(low.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key")
    best = ids.join(found, "key").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each row whose id is divisible by 50."""
    rows = scaled(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(x.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
