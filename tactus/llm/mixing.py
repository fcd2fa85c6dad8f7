"""Mixing sources to target weights by a Pfair schedule, with built-in expressions only.

A source's documents form blocks. Weights become whole shares k of a period P, the sum of shares, so block j of a
source is released at slot floor(j * P / k) and due by slot ceil((j + 1) * P / k). In each slot the released block
with the earliest deadline goes next (ties: the smaller source name). Shares sum to one period, so a released block
always exists, no deadline is missed, and a source's blocks never stand a whole block away from its share while every
source lasts. Shares are thousandths of the weights or, where that is too coarse, the next power of ten at which no source
drifts from its weight by a whole block while it and another last; till then none is two blocks away from its weight.
Windows repeat every P slots; one period, or as much of it as the blocks need, is scheduled and reused for all cycles.
Sources of one share have the same windows, so a slot compares shares, not sources: at most sqrt(2 * P) of them.

All documents keep their place in the order; none is dropped or repeated. Once a source runs out, its slots stay empty.

Edge cases: a null source is a source of its own; a source without a weight, or a weight at or below zero, is an
error; numbering inside a source goes by key bucket, key and text hash, so repeated rows stand side by side; texts of any
length count as one row and only their hash is scheduled; columns of any name pass through in ``row``; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.common import bucket_of, let, no_null, numbered, table

BLOCK_ROWS = 16
#: Shares are weights times this number, rounded, one at least; or times the first of FINER at which no source drifts.
RESOLUTION = 1000
FINER = [10**k for k in range(4, 10)]
#: Without given weights a source's weight is the square root of its row count: between its own share and an equal one.
TEMPERATURE = 0.5
#: Slots that are scheduled between two copies of the order so far.
_RUN = 512


def _source_key(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def shares(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_key, share, blocks): each source's whole share of the period and the blocks it has."""
    counts = docs.select(_source_key(source).alias("_key")).groupBy("_key").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(TEMPERATURE))
    else:
        if min(weights.values(), default=1) <= 0:
            raise ValueError("every weight must be above zero")
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("null" if k is None else f"={k}", float(w))])
        weight = F.coalesce(F.try_element_at(given, F.col("_key")), F.raise_error(F.concat(F.lit("no weight for source "), F.col("_key"))).cast("double"))
    everything = Window.partitionBy()
    rows = counts.withColumn("weight", weight).withColumn("_total", F.sum("weight").over(everything)).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    sizes = [RESOLUTION, *FINER]
    rows = rows.withColumns({f"_k{r}": F.greatest(F.lit(1), F.round(r * F.col("weight") / F.col("_total"))).cast("long") for r in sizes})
    # how many blocks a source is off its weight when its last one goes, or from when on it is alone
    rows = rows.withColumn("_lasts", F.col("blocks") * F.col("_total") / F.col("weight"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_lasts"))))
    rows = rows.withColumn("_lasts", F.least("_lasts", F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("_lasts"))).over(everything), F.lit(0.0))))
    drift = {f"_d{r}": F.max(F.abs(F.col(f"_k{r}") / F.col(f"_p{r}") - F.col("weight") / F.col("_total")) * F.col("_lasts")).over(everything) for r in sizes}
    rows = rows.withColumns({f"_p{r}": F.sum(f"_k{r}").over(everything) for r in sizes}).withColumns(drift)
    share = F.coalesce(*[F.when(F.col(f"_d{r}") < 1, F.col(f"_k{r}")) for r in sizes], F.col(f"_k{sizes[-1]}"))
    return rows.select("_key", share.alias("share"), "blocks")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _due(done: Column, share: Column, period: Column) -> Column:
    return _div((done + 1) * period + share - 1, share)


def period_schedule(share_table: DataFrame) -> DataFrame:
    """(_key, share, period, _turn, slot): when each block of one period goes, earliest deadline first; without the slots
    after the last deadline of any block there is."""
    named = share_table.withColumn("i", (F.row_number().over(Window.orderBy("_key")) - 1).cast("int"))
    classes = named.groupBy("share").agg(F.array_sort(F.collect_list("i")).alias("own"), F.max("blocks").alias("blocks"))
    one = classes.agg(F.array_sort(F.collect_list(F.struct("share", "own", "blocks"))).alias("s")).where(F.size("s") > 0)
    zero = F.lit(0).cast("long")
    one = one.withColumn("p", F.aggregate("s", zero, lambda a, x: a + x["share"] * F.size(x["own"])))
    one = one.withColumn("last", F.least("p", F.array_max(F.transform("s", lambda x: _due(x["blocks"] - 1, x["share"], F.col("p"))))))
    s, p, last = F.col("s"), F.col("p"), F.col("last")

    def pick(done: Column, t: Column) -> Column:
        # a class deals block j of all its sources, by name, before block j + 1 of any
        def job(x: Column, q: Column) -> Column:
            many = F.size(x["own"]).cast("long")
            turn = _div(done[q], many)
            return F.struct(_due(turn, x["share"], p).alias("due"), F.get(x["own"], (done[q] % many).cast("int")).alias("i"), q.alias("q"), _div(turn * p, x["share"]).alias("release"))

        return F.array_min(F.filter(F.transform(s, job), lambda j: j["release"] <= t))

    def step(state: Column, t: Column) -> Column:
        return let(
            pick(state["done"], t),
            lambda chosen: F.struct(
                F.transform(state["done"], lambda v, q: F.when(q == chosen["q"], v + 1).otherwise(v)).alias("done"), F.concat(state["order"], F.array(chosen["i"])).alias("order")
            ),
        )

    def run(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + _RUN, last) - 1)
        begin = F.struct(state["done"].alias("done"), F.array().cast("array<int>").alias("order"))
        return let(F.aggregate(slots, begin, step), lambda x: F.struct(x["done"].alias("done"), F.concat(state["orders"], F.array(x["order"])).alias("orders")))

    start = F.struct(F.transform(s, lambda _: zero).alias("done"), F.array().cast("array<array<int>>").alias("orders"))
    order = F.flatten(F.aggregate(F.sequence(zero, last - 1, F.lit(_RUN).cast("long")), start, run)["orders"])
    slots = one.select("p", F.posexplode(order).alias("slot", "i")).select("i", F.col("p").alias("period"), F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    placed = slots.withColumn("_turn", turn.cast("long"))
    return placed.join(F.broadcast(named), "i").select("_key", "share", "period", "_turn", "slot")


def text_hash() -> Column:
    return F.xxhash64(no_null("text"))


def scheduled(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, tie: Column | None = None) -> DataFrame:
    """``docs`` in a column ``row`` with share, period, block, place (within the block), slot, release and deadline.

    All columns of ``docs`` are moved, so give it those that are needed; rows of one key go by ``tie``, the hash of ``text``
    if none is given.
    """
    tie = text_hash() if tie is None else tie
    rows = docs.select(F.struct(*docs.columns).alias("row"), _source_key(source).alias("_key"), bucket_of(F.col(key)).alias("_bucket"), F.col(key).alias("_id"), tie.alias("_h"))
    rows = numbered(rows, "_key", [F.col("_id"), F.col("_h")], "_number").withColumn("block", F.expr(f"_number div {block_rows}"))
    plan = period_schedule(shares(docs, source, weights, block_rows))
    share = plan.select("_key", "share", "period").distinct()
    rows = rows.join(F.broadcast(share), "_key").withColumn("_turn", F.col("block") % F.col("share"))
    rows = rows.join(F.broadcast(plan.select("_key", "_turn", F.col("slot").alias("_slot"))), ["_key", "_turn"])
    return rows.select(
        "row",
        "share",
        "period",
        "block",
        (F.col("_number") % block_rows).alias("place"),
        (F.expr("block div share") * F.col("period") + F.col("_slot")).alias("slot"),
        F.expr("block * period div share").alias("release"),
        F.expr("((block + 1) * period + share - 1) div share").alias("deadline"),
    )


#: The columns of a row's place in the schedule that a later stage can sort by.
POSITION = ["mixing_slot", "mixing_place"]


def positioned(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the columns of POSITION, in the order of the schedule."""
    ordered = scheduled(docs, **how).select("row.*", *[F.col(c.removeprefix("mixing_")).alias(c) for c in POSITION])
    return ordered.repartitionByRange(*POSITION).sortWithinPartitions(*POSITION)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with their own columns only, in the order of the schedule: the files that are written follow it."""
    return positioned(docs, **how).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and window, under temperature weights of its source."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).select("doc_id", "source", text_hash().alias("tie"))
    return scheduled(docs, tie=F.col("tie")).select("row.doc_id", "row.source", "share", "period", "block", "place", "slot", "release", "deadline")


#: The schedule of a period by recursion over its slots.
SQL = f"""
WITH RECURSIVE c AS (SELECT CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k, count(*) AS n FROM documents GROUP BY 1),
sh AS (SELECT k, CAST(greatest(1, round({RESOLUTION} * CAST(n AS DOUBLE) ** {TEMPERATURE} / sum(CAST(n AS DOUBLE) ** {TEMPERATURE}) OVER ())) AS BIGINT) AS share FROM c),
one AS (SELECT list(k ORDER BY k) AS ks, list(share ORDER BY k) AS ss, CAST(sum(share) AS BIGINT) AS p FROM sh),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ss, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, i: CASE WHEN i = best THEN v + 1 ELSE v END), best
  FROM (SELECT t, done, p, list_min(list_transform(list_filter(range(1, len(ss) + 1), lambda i: done[i] * p // ss[i] <= t + 1),
                 lambda i: {{'due': ((done[i] + 1) * p + ss[i] - 1) // ss[i], 'i': i}})).i AS best FROM edf, one) q
  WHERE t + 1 < p),
plan AS (SELECT ks[pick] AS k, ss[pick] AS share, p AS period, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf, one WHERE t >= 0),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k,
        row_number() OVER (PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, plan.share, period, r // {BLOCK_ROWS} AS block, r % {BLOCK_ROWS} AS place,
  (r // {BLOCK_ROWS} // plan.share) * period + slot AS slot, (r // {BLOCK_ROWS}) * period // plan.share AS release,
  ((r // {BLOCK_ROWS} + 1) * period + plan.share - 1) // plan.share AS deadline
FROM d JOIN plan ON plan.k = d.k AND plan.turn = (r // {BLOCK_ROWS}) % plan.share"""
