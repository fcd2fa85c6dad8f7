"""Two trackers' grids compared and arbitrated; all rules are expressions over one row, so there is no shuffle here.

A row has o_ (ours) and t_ (theirs) bpm, bar, first_ms and down_ms, and vote and agreement of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import grid as g


def _usable() -> Column:
    return F.coalesce((F.col("o_bpm") > 0) & (F.col("t_bpm") > 0) & F.col("o_first_ms").isNotNull() & F.col("t_first_ms").isNotNull(), F.lit(False))


def _period() -> Column:
    return 60.0 / F.when(F.col("o_bpm") > 0, F.col("o_bpm"))


def _bar() -> Column:
    return F.when(F.col("o_bar") > 0, F.col("o_bar")).otherwise(4)


def origin_ms(shift: Column) -> Column:
    """How far their first beat lies from our lattice, moved by ``shift``; halves round away from zero."""
    d = (F.col("t_first_ms") - F.col("o_first_ms") - shift) / F.lit(1000.0)
    return (d - F.round(d / _period()) * _period()) * 1000


def downbeat_beats(shift: Column) -> Column:
    return g.fold((F.col("t_down_ms") - F.col("o_down_ms") - shift) / F.lit(1000.0) / _period(), _bar().cast("double"))


def reasons(shift: Column) -> Column:
    """Why the grids differ, joined by '; '; '' if they agree."""
    told = F.concat_ws(
        "; ",
        F.when(F.abs(F.col("o_bpm") - F.col("t_bpm")) > g.COMPARE_BPM, "bpm"),
        F.when(F.abs(origin_ms(shift)) > g.ORIGIN_SLOP_MS, "origin"),
        F.when(F.abs(downbeat_beats(shift)) > g.DOWNBEAT_SLOP_BEATS, "downbeat"),
    )
    return F.when(_usable(), told).otherwise("missing grid")


def half_beat_shift() -> Column:
    """The raw distance of the first beats, if tempos agree and the grids lie half a beat apart; else null."""
    half = F.abs(F.abs(origin_ms(F.lit(0))) - _period() * 500) <= g.ORIGIN_SLOP_MS
    return F.when(_usable() & (F.abs(F.col("o_bpm") - F.col("t_bpm")) <= g.COMPARE_BPM) & half, F.col("t_first_ms") - F.col("o_first_ms"))


def voted(least: float) -> Column:
    """Their vote for another first beat, if enough agree; else null."""
    return F.when((F.col("vote") != 0) & (F.col("agreement") >= least), F.col("vote"))


def arbitrated(pairs: DataFrame, arbitrate: bool = True) -> DataFrame:
    """Adds shift_ms, relabel_beats, dispute and verdict: shift by half a beat, compare again, relabel if clean, and
    tell a vote that was not taken."""
    out = pairs.withColumn("shift_ms", half_beat_shift() if arbitrate else F.lit(None).cast("long"))
    out = out.withColumn("_reasons", reasons(F.coalesce("shift_ms", F.lit(0))))
    relabel = F.when(F.col("_reasons") == "", voted(g.RELABEL_AGREEMENT)) if arbitrate else F.lit(None).cast("long")
    out = out.withColumn("relabel_beats", relabel)
    folded = F.when(F.col("vote") > F.floor(_bar() / 2), F.col("vote") - _bar()).otherwise(F.col("vote"))
    vote = F.when(F.col("relabel_beats").isNull() & voted(g.DISPUTE_AGREEMENT).isNotNull(), F.concat(F.lit("downbeat vote "), folded.cast("string")))
    out = out.withColumn("dispute", F.concat_ws("; ", F.nullif("_reasons", F.lit("")), vote)).drop("_reasons")
    return out.withColumn("verdict", F.when(F.col("dispute") == "", "agreed").otherwise("disputed"))
