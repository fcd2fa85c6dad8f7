"""Event streams of a batch: sequence checks, item outcomes, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_faults(events: DataFrame, key: str, seq: str) -> DataFrame:
    """For each key its events, and how many do not follow their predecessor by one (the first must be the least)."""
    step = F.col(seq) - F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return events.withColumn("_step", step).groupBy(key).agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col("_step"), F.lit(1)) != 1).alias("faults"))


def outcomes(tasks: DataFrame, item: str, failed: str) -> DataFrame:
    """An item fails if any of its tasks does."""
    return tasks.groupBy(item).agg(F.count("*").alias("tasks"), F.count_if(failed).alias("failed_tasks")).withColumn("outcome", F.when(F.col("failed_tasks") > 0, "failed").otherwise("ok"))


def contiguous(frames: DataFrame, key: str, offset: str, columns: str) -> DataFrame:
    """For each key whether its frames follow one another from 0, and their columns' sum."""
    before = F.sum(columns).over(Window.partitionBy(key).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col(offset) != F.coalesce(before, F.lit(0))
    return frames.withColumn("_gap", gap).groupBy(key).agg(F.count("*").alias("frames"), F.sum(columns).alias("width"), (F.count_if("_gap") == 0).alias("contiguous"))
