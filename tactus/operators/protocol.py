"""The engine's event protocol as tables: events of a batch, grids of trackers, results, and what a crash leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEG = (
    "grid struct<bpm: double, beats_per_bar: long, first_beat_ms: long, first_downbeat_ms: long>, beats array<struct<beat_number: long, time_ms: long>>, "
    "bt_phase_vote long, bt_phase_agreement double, algo_version string, cfg_hash string, origin_refine_ms double, bt_resid_stdev double"
)
GRID_EVENT = (
    "id string, bpm double, beats_per_bar int, beats array<array<long>>, first_downbeat_ms long, "
    "consensus struct<verdict: string, dispute: string, beat_this: struct<phase_vote: long, phase_agreement: double>, relabel_beats: long, shift_ms: long>"
)


def numbered(events: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """``events`` with seq: 1, 2, 3 ... within each batch."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(batch).orderBy(*order)).cast("long"))


def progress(item: Column, stage: Column, done: Column, total: Column) -> Column:
    return F.struct(F.lit("progress").alias("event"), item.alias("id"), stage.alias("stage"), done.alias("done"), total.alias("total"))


def warning(item: Column, task: Column, code: Column, message: Column) -> Column:
    return F.struct(F.lit("item_warning").alias("event"), item.alias("id"), task.alias("task"), code.alias("code"), message.alias("message"))


def error(item: Column, task: Column, code: Column, message: Column, retryable: Column) -> Column:
    return F.struct(F.lit("item_error").alias("event"), item.alias("id"), task.alias("task"), code.alias("code"), message.alias("message"), retryable.alias("retryable"))


def lines(events: Column) -> Column:
    """One JSON line; null fields are left out."""
    return F.to_json(events)


def crashed(items: DataFrame, events: DataFrame, message: str) -> DataFrame:
    """An item_error for each task of the items (batch, id, tasks) that have no item_done, in batches of ``events`` (batch,
    event, id) that neither ended nor were refused."""
    over = events.where(F.col("event").isin("batch_done", "batch_error")).select("batch")
    done = events.where("event = 'item_done'").select("batch", "id")
    left = items.join(over, "batch", "left_anti").join(done, ["batch", "id"], "left_anti")
    rows = left.select("batch", "id", F.explode("tasks").alias("task"))
    return rows.select("batch", error(F.col("id"), F.col("task"), F.lit("engine_crashed"), F.lit(message), F.lit(True)).alias("e")).select("batch", "e.*")


def leg_grid(value: Column, version: str = "") -> Column:
    """A tracker's JSON as a grid: meter four and beat numbers 0 where they are missing, first beats derived; null without
    beats or a tempo."""
    v = F.from_json(value, LEG)
    beats = F.transform(v["beats"], lambda b: F.struct(F.coalesce(b["beat_number"], F.lit(0)).alias("n"), F.coalesce(b["time_ms"], F.lit(0)).alias("ms")))
    grid = F.struct(
        v["grid"]["bpm"].alias("bpm"),
        F.coalesce(v["grid"]["beats_per_bar"], F.lit(4)).alias("beats_per_bar"),
        beats.alias("beats"),
        F.coalesce(v["grid"]["first_beat_ms"], F.get(beats, 0)["ms"]).alias("first_beat_ms"),
        F.coalesce(v["grid"]["first_downbeat_ms"], F.get(F.filter(beats, lambda b: b["n"] == 1), 0)["ms"]).alias("first_downbeat_ms"),
        F.coalesce(v["bt_phase_vote"], F.lit(0)).alias("phase_vote"),
        F.coalesce(v["bt_phase_agreement"], F.lit(0.0)).alias("phase_agreement"),
        F.coalesce(v["algo_version"], F.lit(version)).alias("algo_version"),
        F.coalesce(v["cfg_hash"], F.lit("")).alias("cfg_hash"),
        F.coalesce(v["origin_refine_ms"], F.lit(0.0)).alias("origin_refine_ms"),
        F.coalesce(v["bt_resid_stdev"], F.lit(0.0)).alias("resid_stdev"),
    )
    return F.when((F.size(v["beats"]) > 0) & (v["grid"]["bpm"] > 0), grid)


def result_of(event: Column) -> Column:
    """A grid event's JSON as a result row."""
    e = F.from_json(event, GRID_EVENT)
    c = e["consensus"]
    return F.struct(
        e["id"].alias("id"),
        e["bpm"].alias("bpm"),
        e["beats_per_bar"].alias("beats_per_bar"),
        F.transform(e["beats"], lambda b: F.struct(b[0].alias("n"), b[1].alias("ms"))).alias("beats"),
        e["first_downbeat_ms"].alias("first_downbeat_ms"),
        F.coalesce(c["verdict"], F.lit("")).alias("consensus"),
        F.coalesce(c["dispute"], F.lit("")).alias("dispute"),
        F.coalesce(c["beat_this"]["phase_vote"], F.lit(0)).alias("phase_vote"),
        F.coalesce(c["beat_this"]["phase_agreement"], F.lit(0.0)).alias("phase_agreement"),
        F.coalesce(c["relabel_beats"], F.lit(0)).alias("relabel_beats"),
        F.coalesce(c["shift_ms"], F.lit(0)).alias("shift_ms"),
    )


def on_timeline(beats: Column, start_time: Column) -> Column:
    """Every beat moved by a start time in seconds, rounded to whole milliseconds."""
    return F.transform(beats, lambda b: b.withField("ms", (b["ms"] + F.round(start_time * 1000)).cast("long")))
