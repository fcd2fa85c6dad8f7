"""A track's tempo from its beats: bounded medians, lattices refined in rounds, phases, strengths and the grid laid from them.

Rounds run over one partitioning of the beats (a lattice's on a window's beats as an array), so a track moves once however
many rounds there are. Lattices and origins add their beats in the order of i: sums in the order of arrival differ in the last
bits from run to run, which shows where a figure lies on the half of its last kept decimal.
Beats are rows (track, i, t) with t in seconds and i from 0; ``np.round`` and ``round`` are halves to even, as ``rint`` is.
"""

from __future__ import annotations

from math import fma, nan, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tactus.operators.lattice import MAX_BPM, MIN_BPM, residual

#: Windows of a lattice and their step, rounds of a fit, and the largest drift from the consensus.
WINDOW, STEP, ROUNDS, DRIFT = 64, 32, 3, 0.02
#: Decimals of a spread beyond which windows are equal: spreads of like windows hours apart differ by the rounding of their times.
ALIKE = 10
#: Seconds within which a residual counts for the origin, and how many must.
INLIER, INLIERS = 0.05, 16
#: Least distance of chosen phases, share of residuals that counts, seconds of drift that a simple tempo may cost.
SEPARATION, KEPT, TOLERANCE = 0.05, 0.95, 0.005
#: Activation frames a second, the stretch of audio around a beat, the two weights, candidates kept.
FRAMES, BEFORE, AFTER, ACTIVATION, ENERGY, POSTS = 50.0, 0.05, 0.30, 0.65, 0.35, 4


def gap_period(beats: DataFrame, track: str) -> DataFrame:
    """The median of the gaps between 0.2 and 2 seconds, and its tempo: 0 without such a gap or with fewer than four beats."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(track).orderBy("t"))
    rows = beats.where((F.col("t") > float("-inf")) & (F.col("t") < float("inf"))).withColumn("_gap", gap)
    own = F.when((F.col("_gap") > 0.2) & (F.col("_gap") < 2.0), F.col("_gap"))
    out = rows.groupBy(track).agg(F.count("*").alias("beats"), F.percentile(own, 0.5).alias("period"))
    out = out.withColumn("period", F.when(F.col("beats") >= 4, F.col("period")))
    return out.withColumn("bpm", F.coalesce(60.0 / F.col("period"), F.lit(0.0)))


def consensus(beats: DataFrame, track: str, span: int = 8) -> DataFrame:
    """The median of ``span`` beats' length over ``span``, of those between 0.2 and 1.2 seconds; tracks of ``span`` beats
    or fewer take their median gap."""
    order = Window.partitionBy(track).orderBy("i")
    rows = beats.withColumns({"_span": (F.lead("t", span).over(order) - F.col("t")) / span, "_gap": F.lead("t").over(order) - F.col("t")})
    long = F.percentile(F.when((F.col("_span") > 0.2) & (F.col("_span") < 1.2), F.col("_span")), 0.5)
    return rows.groupBy(track).agg(F.when(F.count("*") > span, long).otherwise(F.percentile("_gap", 0.5)).alias("consensus"))


def _off(t: Column, origin: Column, period: Column) -> Column:
    """The signed distance to the nearest line."""
    return t - (origin + F.rint((t - origin) / period) * period)


@F.udf(StructType([StructField(c, DoubleType()) for c in ("period", "origin", "spread")]), useArrow=True)
def _lattice(times: list[float | None], period: float | None) -> tuple[float | None, float | None, float | None]:
    """The lattice of a window's beats from a first period, by ROUNDS lines; nulls without a line, NaN where a beat is not finite."""

    def line(xs: list[float], ts: list[float]) -> tuple[float | None, float | None]:
        """Least squares in one pass, by the steps of DuckDB's regr_slope and regr_intercept: products are added unrounded."""
        n = mx = mt = xt = xx = sx = st = 0.0
        for x, t in zip(xs, ts):
            n, dx = n + 1, x - mx
            mx, mt = mx + dx / n, mt + (t - mt) / n
            xt, xx = fma(dx, t - mt, xt), fma(x - mx, dx, xx)
            sx, st = sx + x, st + t
        if not xx:
            return None, None
        slope = (xt / n) / (xx / n)
        return slope, fma(-slope, sx / n, st / n)

    origin, own = times[0], [t for t in times if t is not None]
    try:
        for _ in range(ROUNDS):
            if not period or origin is None:
                return None, None, None
            period, origin = line([float(round((t - origin) / period)) for t in own], own)
        if not period:
            return period, origin, None
        n = mean = square = 0.0
        for t in own:
            off = t - (origin + round((t - origin) / period) * period)
            n, d = n + 1, off - mean
            mean += d / n
            square = fma(off - mean, d, square)
        return period, origin, sqrt(square / n)
    except (OverflowError, ValueError):  # of round and fma
        return nan, nan, nan


def fit_windows(beats: DataFrame, track: str) -> DataFrame:
    """(track, start, period, origin, spread, drift) of each window of WINDOW beats, STEP apart, or of a shorter track.

    Each of ROUNDS rounds puts the beats on the lattice so far, at first the consensus period from the window's first
    beat, and fits a line to them. A beat lies in at most WINDOW / STEP windows.
    """
    size = F.least(F.col("_n"), F.lit(WINDOW))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / STEP))
    starts = F.filter(F.transform(F.sequence(low, F.greatest(low, F.floor(F.col("i") / STEP))), lambda k: k * STEP), lambda s: (s <= F.col("i")) & (s <= F.col("_n") - size))
    rows = beats.withColumn("_n", F.count("*").over(Window.partitionBy(track))).join(consensus(beats, track), track)
    rows = rows.select(track, "i", "t", "consensus", F.explode(starts).alias("start"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda b: b["t"])
    rows = rows.groupBy(track, "start").agg(F.first("consensus").alias("consensus"), own.alias("_t")).withColumn("_fit", _lattice("_t", "consensus"))
    out = rows.select(track, "start", "_fit.period", "_fit.origin", "consensus", "_fit.spread")
    return out.withColumn("drift", F.abs(F.col("period") - F.col("consensus")) / F.col("consensus"))


def fit_lattice(beats: DataFrame, track: str) -> DataFrame:
    """Each track's window of least spread among those that drift little, else the one that drifts least; equals by the
    earliest."""
    near = F.col("drift") <= DRIFT
    rank = Window.partitionBy(track).orderBy(~near, F.when(near, F.round("spread", ALIKE)).otherwise(F.col("drift")), "start")
    return fit_windows(beats, track).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def refit_origin(beats: DataFrame, lattices: DataFrame, track: str) -> DataFrame:
    """``lattices`` with refit: the origin moved by the mean residual of the beats near a line, of all if these are few."""
    off = _off(F.col("t"), F.col("origin"), F.col("period"))
    rows = beats.select(track, "i", "t").join(lattices.select(track, "origin", "period"), track).withColumn("_off", off)
    near, own = F.abs("_off") < INLIER, Window.partitionBy(track).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.when(F.count_if(near).over(own) >= INLIERS, F.avg(F.when(near, F.col("_off"))).over(own)).otherwise(F.avg("_off").over(own))
    moved = rows.withColumn("_mean", mean).groupBy(track).agg(F.first("_mean").alias("_mean"))
    return lattices.join(moved, track).withColumn("refit", F.col("origin") + F.col("_mean")).drop("_mean")


def free_period(beats: DataFrame, periods: DataFrame, track: str) -> DataFrame:
    """(track, free): the period of the whole track. Each round puts the beats on the lattice from the first beat and fits a
    line to those within a quarter of a period; with fewer than eight, or a line that does not rise, the period stays."""
    own = Window.partitionBy(track)
    rows = beats.join(periods.select(track, F.col("period").alias("free")), track).withColumns({"_first": F.min_by("t", "i").over(own), "_n": F.count("*").over(own)})
    for _ in range(ROUNDS):
        rows = rows.withColumn("_x", F.rint((F.col("t") - F.col("_first")) / F.col("free")))
        rows = rows.withColumn("_keep", F.abs(F.col("t") - (F.col("_first") + F.col("_x") * F.col("free"))) < F.col("free") / 4)
        rows = rows.withColumns({"_slope": F.regr_slope(F.when(F.col("_keep"), F.col("t")), F.col("_x")).over(own), "_kept": F.count_if("_keep").over(own)})
        moved = (F.col("free") > 0) & (F.col("_n") >= 8) & (F.col("_kept") >= 8) & (F.col("_slope") > 0)
        rows = rows.withColumn("free", F.when(moved, F.col("_slope")).otherwise(F.col("free")))
    return rows.groupBy(track).agg(F.first("free").alias("free"))


def choose_bpm(free: Column, duration: Column) -> Column:
    """(bpm, period, digits): the simplest tempo (whole, one decimal, two) that drifts at most TOLERANCE from the free
    period over the track with the best origin, else as measured, with null digits."""
    measured = 60.0 / free
    arms = [F.bround(measured, d) for d in range(3)]
    out = F.struct(measured.alias("bpm"), free.alias("period"), F.lit(None).cast("int").alias("digits"))
    for d, bpm in reversed(list(enumerate(arms))):
        good = (bpm > 0) & (F.abs(60.0 / bpm - free) * duration / free / 2 <= TOLERANCE)
        out = F.when(good, F.struct(bpm.alias("bpm"), (60.0 / bpm).alias("period"), F.lit(d).alias("digits"))).otherwise(out)
    return out


def grid_origin(anchor: Column, period: Column, snap: float = 0.0) -> Column:
    """The anchor stepped back by whole periods to about 0; an origin of at most ``snap`` seconds is 0."""
    start = F.greatest(F.lit(0.0), anchor)
    first = F.greatest(F.lit(0.0), start - F.floor((start + 0.25 * period) / period) * period)
    return F.when((first > 0) & (first <= snap), F.lit(0.0)).otherwise(first)


def grid_beats(first: Column, period: Column, duration: Column) -> Column:
    """The beats of a constant lattice up to the duration."""
    last = F.floor((duration - first) / period)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: first + k * period)).otherwise(F.array().cast("array<double>"))


def percentile(ordered: Column, share: float) -> Column:
    """The percentile of a sorted array, between its neighbours in proportion."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    return F.get(ordered, low) + (at - low) * (F.coalesce(F.get(ordered, low + 1), F.get(ordered, low)) - F.get(ordered, low))


def ranked_phases(times: Column, period: Column) -> Column:
    """ARRAY<STRUCT<score, p95, phase>>: every distinct phase of the times (four decimals) by the mean of its smallest
    residuals, then their 95th percentile, then the phase. One row a track: the residuals of one phase are held at a time."""
    phases = F.array_distinct(F.transform(times, lambda t: F.bround(F.pmod(t, period), 4)))

    def rated(phase: Column) -> Column:
        errors = F.array(F.array_sort(F.transform(times, lambda t: residual(t, phase, period))))
        keep = F.greatest(F.lit(1), F.rint(F.size(times) * F.lit(KEPT)).cast("int"))
        return F.transform(
            errors,
            lambda e: F.struct((F.aggregate(F.slice(e, 1, keep), F.lit(0.0), lambda a, x: a + x) / keep).alias("score"), percentile(e, 0.95).alias("p95"), phase.alias("phase")),
        )[0]

    return F.array_sort(F.transform(phases, rated))


def apart(ranked: Column, period: Column, limit: int) -> Column:
    """The first ``limit`` phases that lie apart from all chosen before."""
    least = F.least(F.lit(SEPARATION), period / 4)

    def add(chosen: Column, c: Column) -> Column:
        free = (F.size(chosen) < limit) & F.forall(chosen, lambda p: residual(c["phase"], p["phase"], period) >= least)
        return F.when(free, F.concat(chosen, F.array(c))).otherwise(chosen)

    return F.aggregate(ranked, F.filter(ranked, lambda _: F.lit(False)), add)


def fallback_anchor(beats: DataFrame, track: str, low: float = MIN_BPM, high: float = MAX_BPM) -> DataFrame:
    """(track, bpm, period, phase, p95, score): the median gap folded by octaves into the range, and its best phase; no row
    where no octave lies in the range."""
    own = beats.where((F.col("t") >= 0) & (F.col("t") < float("inf")))
    rows = gap_period(own, track).where("bpm > 0")
    octaves = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(low) / F.col("bpm")))) - F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("bpm") / F.lit(high))))
    rows = rows.withColumn("_by", F.pow(F.lit(2.0), octaves)).withColumns({"bpm": F.col("bpm") * F.col("_by"), "period": F.col("period") / F.col("_by")})
    rows = rows.where(F.col("bpm").between(low, high)).join(own.groupBy(track).agg(F.array_sort(F.collect_list("t")).alias("_t")), track)
    rows = rows.withColumn("_best", ranked_phases(F.col("_t"), F.col("period"))[0])
    return rows.select(track, "beats", "bpm", "period", F.col("_best.phase").alias("phase"), F.col("_best.p95").alias("p95"), (F.col("beats") / F.pow(F.col("_best.p95") + 0.005, 1.5)).alias("score"))


def local_fits(beats: DataFrame, centres: DataFrame, track: str, low: float = MIN_BPM, high: float = MAX_BPM) -> DataFrame:
    """For each (track, centre): the line through the WINDOW beats around it, or all of a shorter track of eight at least,
    if its tempo is in the range."""
    total = beats.groupBy(track).agg(F.count("*").alias("_n"))
    size = F.least(F.col("_n"), F.lit(WINDOW))
    start = F.greatest(F.lit(0), F.least(F.col("centre") - F.floor(size / 2), F.col("_n") - size))
    asked = centres.select(track, "centre").join(total, track).where("_n >= 8").withColumns({"start": start, "size": size})
    rows = asked.withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))).join(beats.select(track, "i", "t"), [track, "i"])
    own = Window.partitionBy(track, "centre")
    rows = rows.withColumn("_x", F.col("i") - F.col("start"))
    rows = rows.withColumns({"period": F.regr_slope("t", "_x").over(own), "_phase": F.regr_intercept("t", "_x").over(own)})
    error = F.abs(F.col("t") - F.col("_phase") - F.col("period") * F.col("_x"))
    out = rows.groupBy(track, "centre").agg(F.first("start").alias("start"), F.first("period").alias("period"), (F.max("t") - F.min("t")).alias("span"), F.percentile(error, 0.95).alias("p95"))
    out = out.withColumn("bpm", 60.0 / F.when(F.col("period") > 0, F.col("period"))).where(F.col("bpm").between(low, high))
    return out.withColumn("fit_score", F.col("span") / F.pow(F.col("p95") + 0.005, 1.5))


def activation_strength(activations: Column, time: Column) -> Column:
    """The activation of the frame nearest to a time, the first or last one outside; 0 without frames."""
    at = F.greatest(F.lit(0), F.least(F.size(activations) - 1, F.rint(time * FRAMES).cast("int")))
    return F.coalesce(F.get(activations, at), F.lit(0.0)).cast("double")


def audio_strength(samples: Column, time: Column, norm: Column, rate: int) -> Column:
    """The root mean square from BEFORE before a time to AFTER behind it, over ``norm``, at most 1; 0 without samples."""
    start = F.greatest(F.lit(0), F.rint((time - BEFORE) * rate).cast("int"))
    end = F.least(F.size(samples), F.rint((time + AFTER) * rate).cast("int"))
    square = F.aggregate(F.slice(samples, start + 1, F.greatest(F.lit(0), end - start)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when((F.size(samples) > 0) & (norm > 0) & (end > start), F.least(F.lit(1.0), F.sqrt(square / (end - start)) / norm)).otherwise(F.lit(0.0))


def post_candidates(fits: DataFrame, track: str) -> DataFrame:
    """The POSTS best of ``fits`` (track, centre, t, activation, energy, fit_score, p95) in each track: strength times fit;
    equals by the smaller error, then the earlier one."""
    strength = ACTIVATION * F.col("activation") + ENERGY * F.col("energy")
    rows = fits.withColumn("strength", strength).withColumn("score", F.col("strength") * F.col("fit_score"))
    rank = F.row_number().over(Window.partitionBy(track).orderBy(F.desc("score"), "p95", "t"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= POSTS)
