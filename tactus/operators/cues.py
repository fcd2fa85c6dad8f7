"""Cue points from the novelty of beats' features: candidates at phrase starts, the most novel picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beats of a bar, and how many cues each layout takes.
BAR_BEATS, FRONT, BACK, CUES = 4, 4, 4, 8


def novelty(frames: DataFrame, track: str) -> DataFrame:
    """(track, i, novelty): the distance between the mean features of four beats before and four from beat i, scaled
    so that a track's largest is 1. ``frames`` has (track, i, channel, v), one row for each beat and channel."""
    order = Window.partitionBy(track, "channel").orderBy("i")
    step = frames.withColumns({"a": F.avg("v").over(order.rowsBetween(-BAR_BEATS, -1)), "b": F.avg("v").over(order.rowsBetween(0, BAR_BEATS - 1))})
    beats = step.groupBy(track, "i").agg(F.sqrt(F.sum((F.col("b") - F.col("a")) * (F.col("b") - F.col("a")))).alias("d"))
    whole = Window.partitionBy(track)
    inside = (F.col("i") >= BAR_BEATS) & (F.col("i") < F.count("*").over(whole) - BAR_BEATS)
    beats = beats.withColumn("d", F.when(inside, F.coalesce("d", F.lit(0.0))).otherwise(F.lit(0.0)))
    top = F.max("d").over(whole)
    return beats.select(track, "i", F.when(top > 0, F.col("d") / top).otherwise(F.lit(0.0)).alias("novelty"))


def phrases(curve: DataFrame, track: str, bars: int = 8) -> DataFrame:
    """Beats at every ``bars``-th downbeat but the first, with their place and count; downbeats are every fourth beat."""
    starts = curve.where((F.col("i") % (BAR_BEATS * bars) == 0) & (F.col("i") > 0))
    return starts.withColumns({"place": F.row_number().over(Window.partitionBy(track).orderBy("i")), "total": F.count("*").over(Window.partitionBy(track))})


def _best(track: str, among: Column, most: int) -> Column:
    """Whether a row is one of the ``most`` novel of its track's rows for which ``among`` holds; equals by the earlier."""
    rank = F.row_number().over(Window.partitionBy(track).orderBy(F.desc(among), F.desc("novelty"), "i"))
    return among & (rank <= most)


def picked(candidates: DataFrame, track: str, kind: str) -> DataFrame:
    """``novelty``: the eight most novel; ``mix``: four of the first third and four of the last. Slots in time order."""
    if kind == "novelty":
        marked = candidates.withColumn("_taken", _best(track, F.lit(True), CUES))
    else:
        third = F.greatest(F.lit(1), F.floor(F.col("total") / 3))
        marked = candidates.withColumns({"_front": F.col("place") <= third, "_back": F.col("place") > F.col("total") - third})
        marked = marked.withColumns({"_a": _best(track, F.col("_front"), FRONT), "_b": _best(track, F.col("_back"), BACK)}).withColumn("_taken", F.col("_a") | F.col("_b"))
    chosen = marked.where("_taken")
    slot = F.row_number().over(Window.partitionBy(track).orderBy("i"))
    return chosen.select(track, slot.alias("slot"), "i", F.floor(F.col("i") / BAR_BEATS).alias("bar"))


def nearest_beat(downbeats: DataFrame, beats: DataFrame, track: str) -> DataFrame:
    """Each downbeat with the place of the nearest beat, the first of equals.

    Both tables are merged in time order: the last beat before and the first one after are all that can be nearest, so
    there is no range join.
    """
    both = beats.select(track, "ms", F.col("i").alias("_i"), F.lit(None).cast("long").alias("_d")).union(downbeats.select(track, "ms", F.lit(None).cast("long").alias("_i"), F.col("d").alias("_d")))
    down, own = F.col("_d").isNotNull(), Window.partitionBy(track)
    # both look back from the row, over beats in falling and in rising order: a frame that looks ahead is quadratic
    before = own.orderBy("ms", down, F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    after = own.orderBy(F.desc("ms"), ~down, F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_i").isNotNull(), F.struct("ms", "_i"))
    near = both.withColumns({"before": F.last(point, ignorenulls=True).over(before), "after": F.last(point, ignorenulls=True).over(after)}).where("_d is not null")
    later = F.col("after").isNotNull() & (F.col("before").isNull() | (F.col("after.ms") - F.col("ms") < F.col("ms") - F.col("before.ms")))
    return near.select(track, F.col("_d").alias("d"), F.when(later, F.col("after._i")).otherwise(F.col("before._i")).alias("i"))
