"""Waveform columns: bucketed reductions, bit fields, colours, previews, and section comparison.

Samples and bytes are rows (track, j, v), so a track of any length is reduced by partial aggregates and never stands in
one row. Neighbouring columns come from window functions over a track's reduced columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW_WIDTH = 400
#: Weights of the neighbours in a preview's low and middle lanes.
BLEND_BEFORE, BLEND_AFTER = (0.45, 0.35, 0.0), (0.05, 0.0, 0.0)


def detail_width(n: Column, rate: Column) -> Column:
    """Columns of a detail wave: 150 a second, at least one."""
    return F.greatest(F.lit(1), F.expr("1") * F.floor((n * 150 + rate - 1) / rate)).cast("long")


def bucketed(samples: DataFrame, track: str, width: int) -> DataFrame:
    """(track, column, v): each sample with its column of ``width``; a track with fewer samples repeats them."""
    total = samples.groupBy(track).agg(F.count("*").alias("_n"))
    n, j, w = F.col("_n"), F.col("j"), F.lit(width).cast("long")
    first = F.when(n >= w, F.floor(((j + 1) * w - 1) / n)).otherwise(F.ceil(j * w / n))
    last = F.when(n >= w, first).otherwise(F.ceil((j + 1) * w / n) - 1)
    rows = samples.join(total, track)
    return rows.select(track, "v", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("column"))


def bucket_max(samples: DataFrame, track: str, width: int) -> DataFrame:
    """Each column's largest value."""
    return bucketed(samples, track, width).groupBy(track, "column").agg(F.max("v").alias("v"))


def packed_energy(energy: Column) -> Column:
    """A byte: height in five bits, at least one for any sound, and whiteness in three."""
    height = F.greatest(F.lit(1), F.least(F.lit(31), F.round(energy * 31.0))).cast("int")
    white = F.when(height >= 30, 6).when(height >= 24, 5).otherwise(4)
    return F.when(energy > 0, F.shiftleft(white, 5).bitwiseOR(height)).otherwise(0)


def mono_energy(samples: DataFrame, track: str, width: int) -> DataFrame:
    """Each column's packed mean energy of samples scaled by 32768."""
    level = F.col("v") / F.lit(32768.0)
    means = bucketed(samples, track, max(width, PREVIEW_WIDTH)).groupBy(track, "column").agg(F.avg(level * level).alias("energy"))
    return means.select(track, "column", packed_energy(F.col("energy")).alias("byte"))


def clamp_byte(x: Column) -> Column:
    return F.when(F.isnan(x), 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("int")


def held(columns: DataFrame, track: str, lane: str, decay: float) -> DataFrame:
    """Each column at least the rounded decay of the column before it, as it came in."""
    before = F.lag(lane).over(Window.partitionBy(track).orderBy("column"))
    return columns.withColumn("held", F.greatest(F.col(lane), F.coalesce(F.round(before * decay), F.lit(0.0)).cast("int")))


def blended(columns: DataFrame, track: str, lane: str, number: int) -> DataFrame:
    """Each column mixed with its neighbours; at the edges with itself."""
    order = Window.partitionBy(track).orderBy("column")
    own, before, after = F.col(lane), BLEND_BEFORE[number], BLEND_AFTER[number]
    mixed = own * (1 - before - after) + F.coalesce(F.lag(lane).over(order), own) * before + F.coalesce(F.lead(lane).over(order), own) * after
    return columns.withColumn("blended", clamp_byte(F.round(mixed)))


def fields(section: str, value: Column) -> dict[str, Column]:
    """The fields of an entry: a byte of the one-byte sections, or a big-endian pair for PWV5."""
    if section in ("PWAV", "PWV3"):
        return {"height": value.bitwiseAND(31), "white": F.shiftright(value, 5)}
    if section == "PWV2":
        return {"height": value.bitwiseAND(15)}
    if section == "PWV5":
        return {name: F.shiftright(value, by).bitwiseAND(mask) for name, by, mask in (("red", 13, 7), ("green", 10, 7), ("blue", 7, 7), ("height", 2, 31))}
    if section == "PWVC":
        return {"scale": F.least(F.lit(255), value)}
    return {"bytes": value}


def compared(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """For each key exact (percent), mae, corr and compared over (ref, got) rows; corr is 0 if a side is constant.

    One pass of sums, so that partial aggregates do the work.
    """
    r, g = F.col("ref").cast("double"), F.col("got").cast("double")
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("compared"), F.avg((r == g).cast("double")).alias("same"), F.avg(F.abs(r - g)).alias("mae"), F.covar_pop(r, g).alias("cov"), F.var_pop(r).alias("vr"), F.var_pop(g).alias("vg")
    )
    corr = F.when((F.col("vr") > 0) & (F.col("vg") > 0), F.try_divide(F.col("cov"), F.sqrt(F.col("vr") * F.col("vg")))).otherwise(F.lit(0.0))
    return sums.select(*keys, (100 * F.col("same")).alias("exact"), "mae", corr.alias("corr"), "compared")


def rounded_up(x: Column) -> Column:
    """Up to three decimals."""
    return F.floor(x * 1000 + F.lit(0.999)) / F.lit(1000.0)


def band_db(samples: DataFrame, track: str, hop: int) -> DataFrame:
    """The RMS of every ``hop`` samples in dB below the track's loudest, at least -120."""
    rms = samples.groupBy(track, F.floor(F.col("j") / hop).alias("frame")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    top = F.max("rms").over(Window.partitionBy(track))
    db = F.when((top > 0) & (F.col("rms") > 0), 20 * F.log10(F.col("rms") / top)).otherwise(F.lit(-120.0))
    return rms.select(track, "frame", F.greatest(F.lit(-120.0), db).alias("db"))
