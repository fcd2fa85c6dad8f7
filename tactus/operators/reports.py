"""What a person reads: why grids differ, notes of a finished grid, and a score's line. Figures as ``printf`` has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions import grid as g
from tactus.operators import consensus as C


def reasons() -> Column:
    """Why two grids differ, with figures: what ``consensus.reasons`` names; '' if they agree."""
    bpm = F.when(F.abs(F.col("o_bpm") - F.col("t_bpm")) > g.COMPARE_BPM, F.format_string("bpm %.2f vs %.2f", "o_bpm", "t_bpm"))
    origin, downbeat = C.origin_ms(F.lit(0)), C.downbeat_beats(F.lit(0))
    told = F.concat_ws(
        "; ",
        bpm,
        F.when(F.abs(origin) > g.ORIGIN_SLOP_MS, F.format_string("origin %+.0fms", origin)),
        F.when(F.abs(downbeat) > g.DOWNBEAT_SLOP_BEATS, F.format_string("downbeat %+.1f beats", downbeat)),
    )
    return F.when(C._usable(), told).otherwise("missing grid")


def vote_dispute(vote: Column, agreement: Column, bar: Column) -> Column:
    """A vote for another first beat as an objection, folded by the voter's bar; null if too few agree."""
    meter = F.when(bar > 0, bar).otherwise(4)
    folded = F.when(vote > F.floor(meter / 2), vote - meter).otherwise(vote).cast("bigint")
    return F.when((vote != 0) & (agreement >= g.DISPUTE_AGREEMENT), F.format_string("downbeat vote %+d beats (%.2f agree)", folded, agreement.cast("double")))


def arbitrated(pairs: DataFrame, arbitrate: bool = True) -> DataFrame:
    """``pairs`` (o_bpm, o_bar, o_beats of (n, ms), t_bpm, t_bar, t_first_ms, t_down_ms, vote, agreement) with beats,
    shift_ms, relabel_beats, dispute and verdict.

    Our beats move by half a beat where theirs lie there, none before zero; the moved grid is compared again; if it agrees,
    a confident vote renumbers it. What is left of either is the dispute.
    """

    def firsts(beats: Column) -> dict[str, Column]:
        return {"o_first_ms": F.get(beats, 0)["ms"], "o_down_ms": F.get(F.filter(beats, lambda b: b["n"] == 1), 0)["ms"]}

    out = pairs.withColumns(firsts(F.col("o_beats")))
    nothing = F.lit(None).cast("bigint")
    out = out.withColumn("shift_ms", C.half_beat_shift().cast("bigint") if arbitrate else nothing)
    out = out.withColumn("beats", F.when(F.col("shift_ms").isNull(), F.col("o_beats")).otherwise(g.shift(F.col("o_beats"), F.col("shift_ms"))))
    out = out.withColumns(firsts(F.col("beats"))).withColumn("_told", reasons())
    confident = (F.col("_told") == "") & (F.col("vote") != 0) & (F.col("agreement") >= g.RELABEL_AGREEMENT)
    out = out.withColumn("relabel_beats", F.when(confident, F.col("vote").cast("bigint")) if arbitrate else nothing)
    bar = F.when(F.col("o_bar") > 0, F.col("o_bar")).otherwise(4).cast("bigint")
    numbered = F.transform(F.col("beats"), lambda b, i: b.withField("n", g.relabel(b["n"], i, F.col("relabel_beats"), bar).cast("bigint")))
    out = out.withColumn("beats", F.when(F.col("relabel_beats").isNull(), F.col("beats")).otherwise(numbered))
    vote = F.when(F.col("relabel_beats").isNull(), vote_dispute(F.col("vote"), F.col("agreement"), F.col("t_bar")))
    out = out.withColumn("dispute", F.concat_ws("; ", F.nullif("_told", F.lit("")), vote)).drop("_told")
    return out.withColumn("verdict", F.when(F.col("dispute") == "", "agreed").otherwise("disputed"))


def timeline_note(offset_ms: Column, shift_ms: Column, name: Column) -> Column:
    return F.format_string("%+.3f ms applied as %+d (%s)", offset_ms.cast("double"), shift_ms.cast("bigint"), name)


def consensus_note(verdict: Column, vote: Column, agreement: Column, shift_ms: Column, relabel_beats: Column, dispute: Column) -> Column:
    """A verdict and what was done, joined by '; '; without what there is not."""
    return F.concat_ws(
        "; ",
        verdict,
        F.when(vote.isNotNull(), F.format_string("vote %+d at %.2f", vote.cast("bigint"), agreement.cast("double"))),
        F.when(shift_ms.isNotNull(), F.format_string("shifted %+d ms", shift_ms.cast("bigint"))),
        F.when(relabel_beats.isNotNull(), F.format_string("relabelled %+d beats", relabel_beats.cast("bigint"))),
        F.nullif(dispute, F.lit("")),
    )


def identity_note(digest: Column, recipe: Column) -> Column:
    return F.concat(F.substring(digest, 1, 12), F.lit(" ("), recipe, F.lit(")"))


def score_line(scores: DataFrame) -> Column:
    """One line of a score row: path, error_text, pass, got_ and ref_ bpm and bar, bpm_delta, phase_beats, bars,
    got_downbeat_ms, seconds and dispute."""
    dispute = F.when(F.coalesce(F.col("dispute"), F.lit("")) != "", F.concat(F.lit("  disputed: "), "dispute")).otherwise("")
    whole = [F.col(c).cast("bigint") for c in ("got_bar", "ref_bar", "bars", "got_downbeat_ms")]
    line = F.format_string(
        "%s  %s  bpm %.2f vs %.2f (Δ%+.2f)  meter %d vs %d  phase %+.2f beats  bars %+d  downbeat %d ms  %.1fs%s",
        F.when(F.col("pass"), "pass").otherwise("FAIL"), "path", "got_bpm", "ref_bpm", "bpm_delta", whole[0], whole[1], "phase_beats", whole[2], whole[3], "seconds", dispute,
    )
    return F.when(F.coalesce(F.col("error_text"), F.lit("")) != "", F.concat(F.lit("ERROR "), "path", F.lit("  "), "error_text")).otherwise(line)


def reference_of(results: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """``references`` (key, bpm, first_downbeat_ms, beats_per_bar, note) with what results say: their tempo, their meter or
    four, and their first downbeat where they have one."""
    got = results.select(key, F.col("bpm").alias("_bpm"), F.col("first_downbeat_ms").alias("_down"), F.col("beats_per_bar").alias("_bar"))
    rows = references.join(got, key, "left")
    there = F.col("_bpm").isNotNull()
    meter = F.when(F.col("_bar") > 0, F.col("_bar")).otherwise(4)
    return rows.withColumns({"bpm": F.coalesce("_bpm", "bpm"), "first_downbeat_ms": F.coalesce("_down", "first_downbeat_ms"), "beats_per_bar": F.when(there, meter).otherwise(F.col("beats_per_bar"))}).drop("_bpm", "_down", "_bar")
