"""Invariants: grids, requests, tasks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_faults(beats: DataFrame, track: str, bar: int = 4) -> DataFrame:
    """For each track how many numbers lie outside the bar, do not follow their predecessor, or go back in time."""
    order = Window.partitionBy(track).orderBy("i")
    before, time = F.lag("n").over(order), F.lag("ms").over(order)
    marked = beats.withColumns({"outside": ~F.col("n").between(1, bar), "jumps": before.isNotNull() & (F.col("n") != before % bar + 1), "back": time.isNotNull() & (F.col("ms") < time)})
    return marked.groupBy(track).agg(*[F.count_if(c).alias(c) for c in ("outside", "jumps", "back")])


def side_by_side(left: DataFrame, right: DataFrame, track: str, most: int = 8) -> DataFrame:
    """The first beats of two grids with their distance."""
    a = left.where(F.col("i") < most).select(track, "i", F.col("ms").alias("left_ms"))
    b = right.where(F.col("i") < most).select(track, "i", F.col("ms").alias("right_ms"))
    return a.join(b, [track, "i"], "full").withColumn("delta", F.col("right_ms") - F.col("left_ms"))


def conformance_fold(beats: Column, bar: Column) -> Column:
    """An offset in beats folded by rounded bars: half a bar ahead becomes half a bar behind."""
    return beats - F.round(beats / bar) * bar


def is_audio(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(mp3|aiff|aif|wav|flac|m4a)$")


def request_faults(items: DataFrame, most: int = 64) -> DataFrame:
    """A request of (id, tasks): its size, and whether it has too many items, blank or repeated ids, or no tasks."""
    per = items.groupBy("id").agg(F.count("*").alias("n"), F.min(F.size("tasks")).alias("tasks"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(F.coalesce(F.trim("id") == "", F.lit(True))).alias("blank_ids"), F.count_if(F.col("tasks") < 1).alias("without_tasks"))
    return out.withColumn("valid", F.col("items").between(1, most) & (F.col("repeated_ids") == 0) & (F.col("blank_ids") == 0) & (F.col("without_tasks") == 0))


def runnable(tasks: DataFrame) -> DataFrame:
    """(id, task, has_audio, inputs): a task runs with audio, or as ``cues`` with both of its inputs."""
    runs = F.col("has_audio") | ((F.col("task") == "cues") & (F.col("inputs") >= 2))
    return tasks.withColumn("outcome", F.when(runs, "run").otherwise("audio_missing"))
