"""Constant-tempo lattices fitted to beat times: windowed least squares, consensus periods, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, STEP = 16, 8
#: The reference's windows for an anchor: also twice as long where a track has as many beats, and no anchor below half.
ANCHOR_WINDOW = 64
#: The lattice's default tempo range.
MIN_BPM, MAX_BPM = 70.0, 150.0


def indexed(beats: DataFrame, track: str, time: str) -> DataFrame:
    """``beats`` with i: the place of each beat in its track."""
    return beats.withColumn("i", F.row_number().over(Window.partitionBy(track).orderBy(time)) - 1)


def windows(beats: DataFrame, track: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """Each beat once for each window that holds it: (track, start, x, t), only whole windows.

    A beat lies in at most size / step windows, so the rows grow in proportion and no range join is needed.
    """
    total = beats.groupBy(track).agg(F.count("*").alias("_n"))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step))
    starts = F.filter(F.transform(F.sequence(low, F.floor(F.col("i") / step)), lambda k: k * step), lambda s: s <= F.col("_n") - size)
    return beats.join(total, track).select(track, "i", "t", F.explode(starts).alias("start")).withColumn("x", F.col("i") - F.col("start"))


def anchor_windows(beats: DataFrame, track: str, size: int = ANCHOR_WINDOW, step: int = STEP) -> DataFrame:
    """The windows that an anchor is chosen from: (track, size, start, x, t).

    Finite beats from 0 on count. Windows have ``size`` beats, and in tracks of 2 * size beats or more also 2 * size; a
    shorter track is one window, and one of fewer than size / 2 (or 8) beats has none.
    """
    own = beats.where((F.col("t") >= 0) & (F.col("t") < float("inf"))).select(track, "i", "t")
    own = own.withColumn("i", F.row_number().over(Window.partitionBy(track).orderBy("i")) - 1)
    n = F.col("_n")
    some = F.when(n < size, F.array(n)).when(n < 2 * size, F.array(F.lit(size).cast("long"))).otherwise(F.array(*[F.lit(k).cast("long") for k in (size, 2 * size)]))
    total = own.groupBy(track).agg(F.count("*").alias("_n")).where(n >= max(8, size // 2)).select(track, "_n", F.explode(some).alias("size"))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("size") + 1) / step))
    starts = F.filter(F.transform(F.sequence(low, F.floor(F.col("i") / step)), lambda k: k * step), lambda s: s <= n - F.col("size"))
    return own.join(total, track).where(low <= F.floor(F.col("i") / step)).select(track, "size", "i", "t", F.explode(starts).alias("start")).withColumn("x", F.col("i") - F.col("start"))


def fitted(windowed: DataFrame, track: str) -> DataFrame:
    """Least squares of each window: period, origin, its span and the median and 95th percentile of the errors."""
    key = [track, *(["size"] if "size" in windowed.columns else []), "start"]
    own = Window.partitionBy(*key)  # the windows move once: the line by a window function, the rest by an aggregate on the same keys
    rows = windowed.withColumns({"period": F.regr_slope("t", "x").over(own), "origin": F.regr_intercept("t", "x").over(own)})
    err = F.abs(F.col("t") - F.col("origin") - F.col("period") * F.col("x"))
    out = rows.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("period", "origin")], F.min("t").alias("lo"), F.max("t").alias("hi"), F.percentile(err, 0.5).alias("median_error"), F.percentile(err, 0.95).alias("p95_error")
    )
    return out.where("period > 0").withColumns({"bpm": 60.0 / F.col("period"), "span": F.col("hi") - F.col("lo")})


def anchored(fits: DataFrame, track: str, low: float = MIN_BPM, high: float = MAX_BPM) -> DataFrame:
    """Each track's best window in the tempo range: the longest for its error; equals by the smaller size, then the earliest start."""
    score = F.col("span") / F.pow(F.col("p95_error") + 0.005, 1.5)
    rank = Window.partitionBy(track).orderBy(F.desc("score"), *(["size"] if "size" in fits.columns else []), "start")
    return fits.where(F.col("bpm").between(low, high)).withColumn("score", score).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def consensus_period(beats: DataFrame, track: str, span: int = 8) -> DataFrame:
    """The median of ``span`` beats' length over ``span``."""
    ahead = F.lead("t", span).over(Window.partitionBy(track).orderBy("i"))
    return beats.withColumn("step", (ahead - F.col("t")) / span).where("step > 0").groupBy(track).agg(F.percentile("step", 0.5).alias("period"), F.count("*").alias("spans"))


def residual(t: Column, origin: Column, period: Column) -> Column:
    """Distance to the nearest line of a lattice."""
    return F.abs(F.pmod(t - origin + period / 2, period) - period / 2)


def phase_vote(downbeats: DataFrame, track: str, bar: int = 4) -> DataFrame:
    """Which beat of the bar most downbeats fall on, and the share that does; equals by the smallest.

    ``downbeats`` has t, origin and period. Halves round to even.
    """
    vote = F.pmod(F.rint((F.col("t") - F.col("origin")) / F.col("period")).cast("long"), F.lit(bar))
    counts = downbeats.withColumn("vote", vote).groupBy(track, "vote").agg(F.count("*").alias("n"))
    best = F.max_by("vote", F.struct(F.col("n"), -F.col("vote")))
    return counts.groupBy(track).agg(best.alias("vote"), (F.max("n") / F.sum("n")).alias("agreement"))


def octave_folded(bpm: Column, low: float = MIN_BPM, high: float = MAX_BPM) -> Column:
    """A tempo doubled or halved into the range, as far as one power of two does it; else null."""
    up = bpm * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(low) / bpm))))
    down = up / F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(up / F.lit(high)))))
    return F.when(down.between(low, high), down)


def numbered_from_downbeats(beats: DataFrame, track: str) -> DataFrame:
    """Bar positions that start again at each downbeat: 1, 2, 3, 4, 1 ... (``down`` marks a downbeat)."""
    order = Window.partitionBy(track).orderBy("i")
    part = F.sum(F.col("down").cast("int")).over(order)
    run = beats.withColumn("_part", part)
    place = F.row_number().over(Window.partitionBy(track, "_part").orderBy("i")) - 1
    return run.withColumn("n", (place % 4 + 1).cast("long")).drop("_part")
