"""The relational catalog: describing, merging, validating and matching tracks and their analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_analysis(analyses: DataFrame, track: str, order: list[Column]) -> DataFrame:
    """Each track's first analysis in an order (the selected one, then the newest). The rank's limit works before the
    shuffle, so a track with very many analyses sends one row of each task."""
    rank = F.row_number().over(Window.partitionBy(track).orderBy(*order))
    return analyses.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def children_of(child: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The child rows of kept analyses."""
    return child.join(kept.select(key).distinct(), key, "left_semi")


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str, order: list[str]) -> DataFrame:
    """Incoming rows whose keys the target lacks, numbered on from its largest id, none of them selected.

    Null and '' are the same key. Rows that repeat a key inside ``incoming`` are all kept. Numbers are given in two
    steps, so that no task sorts all rows: counts of ranges first, then places inside a range.
    """
    blank = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    have = existing.select(*blank).distinct()
    fresh = incoming.select("*", *blank).join(have, [f"_{k}" for k in keys], "left_anti").drop(*[f"_{k}" for k in keys])
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    return renumbered(fresh, order).join(F.broadcast(top)).withColumn("new_id", F.col("_top") + F.col("_place")).drop("_top", "_place").withColumn("selected", F.lit(0))


def renumbered(rows: DataFrame, order: list[str], step: int = 4096) -> DataFrame:
    """``rows`` with ``_place``: 1, 2, 3 ... by ``order``, whose first column is an integer that ranges are cut from.

    Ranges are counted inside blocks of ``step`` ranges and blocks among themselves, so only blocks meet in one task.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order[0]) / step))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_range") / step))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each step * step numbers in use
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_inside", inside).join(blocks, "_block").select("_range", (F.col("_base") + F.col("_inside")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", within).join(starts, "_range").withColumn("_place", F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def missing_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table the rows whose key columns are null or blank, and its rows: one partial aggregate a table."""
    out = None
    for name, (df, keys) in tables.items():
        blank = F.lit(False)
        for k in keys:
            blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
        one = df.agg(F.lit(name).alias("table_name"), F.count_if(blank).alias("missing"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


def first_filled(*columns: Column) -> Column:
    """The first of some strings that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def prefix_match(name: Column, wanted: Column) -> Column:
    """True if one of two names, lower case and without spaces around, starts with the other; never for empty ones."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(wanted))
    return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))
