"""Grids reduced from beats, and one provider's grids scored against another's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions import grid as g


def reduce_grids(beats: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of a beats table (n, tempo, ms, ord): a grid's tempo, meter, first downbeat and size.

    ``first_downbeat_ms`` is laid back to bar one; ``first_one_ms`` is the first beat that is numbered one.
    A partial aggregate, so a long track is summed where it lies.
    """
    first = F.min_by(F.struct("n", "tempo", "ms"), "ord")
    out = beats.groupBy(*keys).agg(
        first.alias("first"), F.max("n").alias("beats_per_bar"), F.count("*").alias("beats"), F.min("tempo").alias("lo"), F.max("tempo").alias("hi"), F.min(F.when(F.col("n") == 1, F.col("ms"))).alias("first_one_ms")
    )
    bpm = F.col("first.tempo") / F.lit(100.0)
    return out.select(
        *keys,
        bpm.alias("bpm"),
        F.col("beats_per_bar"),
        F.col("beats"),
        (F.col("lo") != F.col("hi")).alias("dynamic"),
        F.col("first.ms").alias("first_ms"),
        g.laid_back_downbeat(F.col("first.ms"), F.col("first.n"), bpm).cast("long").alias("first_downbeat_ms"),
        "first_one_ms",
    )


def gap_rulers(beats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period): the upper median of each key's positive beat gaps in seconds, null without one. Gaps are ranked, not
    listed, so a long track is no long row."""
    own = Window.partitionBy(*keys)
    gap = (F.col("ms") - F.lag("ms").over(own.orderBy("ms", "ord"))) / F.lit(1000.0)
    rows = beats.select(*keys, "ms", "ord").withColumn("_gap", gap).withColumn("_gap", F.when(F.col("_gap") > 0, F.col("_gap")))
    rows = rows.withColumns({"_r": F.row_number().over(own.orderBy(F.col("_gap").asc_nulls_last())), "_n": F.count("_gap").over(own)})
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_gap"))).alias("period"))


def score(pairs: DataFrame) -> DataFrame:
    """``pairs`` has ref_ and got_ bpm, downbeat_ms and bar, and may have got_gap; adds bpm_delta, phase_beats, bars, pass
    and class.

    Offsets are measured by the reference's beat; without its tempo by got_gap, the upper median of the result's positive
    beat gaps in seconds; without that by the result's tempo. A reference that starts before zero cannot count bars, so
    its bars are zero. Without a downbeat the row is an error.
    """
    gap = F.col("got_gap") if "got_gap" in pairs.columns else F.lit(None).cast("double")
    period = F.coalesce(F.when(F.col("ref_bpm") > 0, 60.0 / F.col("ref_bpm")), F.when(gap > 0, gap), F.when(F.col("got_bpm") > 0, 60.0 / F.col("got_bpm")))
    bar = F.when(F.col("ref_bar") > 0, F.col("ref_bar")).otherwise(4).cast("double")
    offset = (F.col("got_downbeat_ms") - F.col("ref_downbeat_ms")) / F.lit(1000.0)
    beats, bars = g.phase(offset, F.coalesce(period, F.lit(0.0)), bar)
    out = pairs.withColumns({"error": F.col("got_downbeat_ms").isNull() | F.col("got_bpm").isNull(), "bar": bar, "bpm_delta": F.col("got_bpm") - F.col("ref_bpm"), "phase_beats": beats})
    out = out.withColumn("bars", F.when(F.col("ref_downbeat_ms") < 0, F.lit(0.0)).otherwise(bars).cast("long"))
    meter = (F.when(F.col("ref_bar") > 0, F.col("ref_bar")).otherwise(4) == F.col("got_bar")).alias("same_meter")
    out = out.withColumn("same_meter", F.coalesce(meter, F.lit(False)))
    good = ~F.col("error") & F.col("same_meter") & (F.abs("bpm_delta") <= g.MAX_BPM_DELTA) & (F.abs("phase_beats") <= g.MAX_PHASE_BEATS) & (F.col("bars") == 0)
    out = out.withColumn("pass", F.coalesce(good, F.lit(False)))
    kind = g.failure_class(F.col("error"), F.col("same_meter"), F.col("bpm_delta"), F.col("ref_bpm"), F.col("got_bpm"), F.col("phase_beats"), F.col("bars"))
    return out.withColumn("class", F.when(F.col("pass"), "pass").otherwise(kind))


def breakdown(scores: DataFrame, place: str) -> DataFrame:
    """Failures by class, the most frequent first, equals by first place."""
    return scores.where("not pass").groupBy("class").agg(F.count("*").alias("n"), F.min(place).alias("first_place")).orderBy(F.desc("n"), "first_place")


def report(scores: DataFrame) -> DataFrame:
    """One row of totals."""
    return scores.agg(F.count("*").alias("tracks"), F.count_if("pass").alias("passed"), F.count_if("error").alias("errors"))
