"""Queries of a track's tempo, each with the DuckDB SQL of the same rows.

The stand-in for a track's beats are a user's events in order: one each half second, up to 40 ms late by the event's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.operators import trackers as T
from tactus.plans.grids import query, read


def paced(spark, sf) -> DataFrame:
    rows = read(spark, sf, "events", "event_id", "ts", "user_id")
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return rows.select(F.col("user_id").alias("track"), i.alias("i"), (F.lit(0.3) + i * 0.5 + F.col("event_id") % 41 / F.lit(1000.0)).alias("t"))


def _rounded(df: DataFrame, keys: list[str], **places: int) -> DataFrame:
    return df.select(*keys, *[F.round(c, n).alias(c) for c, n in places.items()])


def _scaled(c: Column, places: int) -> Column:
    """``c`` rounded as DuckDB rounds: scaled, to the nearest whole number (halves away from 0) and back. Spark's ``round`` takes the
    digits as printed instead, which differs for figures within a bit of a half."""
    return F.round(c * 10.0**places, 0) / 10.0**places


P = """p AS (SELECT user_id AS track, r AS i, CAST(0.3 AS DOUBLE) + r * CAST(0.5 AS DOUBLE) + event_id % 41 / CAST(1000 AS DOUBLE) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) e),
c AS (SELECT track, CASE WHEN count(*) > 8 THEN quantile_cont(s, 0.5) FILTER (s > 0.2 AND s < 1.2) ELSE quantile_cont(g, 0.5) END AS consensus
  FROM (SELECT *, (lead(t, 8) OVER o - t) / 8 AS s, lead(t) OVER o - t AS g FROM p WINDOW o AS (PARTITION BY track ORDER BY i)) x GROUP BY 1)"""
_ROUND = "{n} AS (SELECT * EXCLUDE (period, origin, x), regr_slope(t, x) OVER w AS period, regr_intercept(t, x) OVER w AS origin FROM (SELECT *, round_even((t - origin) / period, 0) AS x FROM {m}) q WINDOW w AS (PARTITION BY track, start))"
W = f"""{P}, n AS (SELECT track, count(*) AS n FROM p GROUP BY 1),
w0 AS (SELECT p.track, i, t, s * 32 AS start, consensus, consensus AS period, first_value(t) OVER (PARTITION BY p.track, s ORDER BY i) AS origin
  FROM p JOIN n ON n.track = p.track JOIN c ON c.track = p.track JOIN range(0, 10000) r(s) ON s * 32 <= i AND i < s * 32 + least(n, 64) AND s * 32 <= n - least(n, 64)),
{", ".join(_ROUND.format(n=f"w{k}", m=f"w{k - 1}") for k in (1, 2, 3))},
f AS (SELECT track, start, any_value(period) AS period, any_value(origin) AS origin, any_value(consensus) AS consensus,
  stddev_pop(t - (origin + round_even((t - origin) / period, 0) * period)) AS spread FROM w3 GROUP BY 1, 2),
d AS (SELECT *, abs(period - consensus) / consensus AS drift FROM f),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY drift > 0.02, CASE WHEN drift <= 0.02 THEN spread ELSE drift END, start) AS r FROM d) q WHERE r = 1),
o AS (SELECT p.track, t - (origin + round_even((t - origin) / period, 0) * period) AS off FROM p JOIN l ON l.track = p.track),
ro AS (SELECT l.track, origin, period, origin + CASE WHEN count(*) FILTER (abs(off) < 0.05) >= 16 THEN avg(off) FILTER (abs(off) < 0.05) ELSE avg(off) END AS refit FROM l JOIN o ON o.track = l.track GROUP BY 1, 2, 3)"""


@query(f"""WITH {P}, g AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS g FROM p), m AS (SELECT track, count(*) AS beats, CASE WHEN count(*) >= 4 THEN quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 2) END AS period FROM g GROUP BY 1)
SELECT track, beats, round(period, 6) AS period, round(coalesce(60 / period, 0), 4) AS bpm FROM m""")
def tempo_by_gaps(spark, sf):
    return _rounded(T.gap_period(paced(spark, sf), "track"), ["track", "beats"], period=6, bpm=4)


@query(f"WITH {P} SELECT track, round(consensus, 7) AS consensus FROM c")
def tempo_consensus(spark, sf):
    return _rounded(T.consensus(paced(spark, sf), "track"), ["track"], consensus=7)


@query(f"WITH {W} SELECT track, start, round(period, 6) AS period, round(origin, 6) AS origin, round(spread, 6) AS spread, round(drift, 6) AS drift FROM d")
def lattice_windows(spark, sf):
    return _rounded(T.fit_windows(paced(spark, sf), "track"), ["track", "start"], period=6, origin=6, spread=6, drift=6)


@query(f"WITH {W} SELECT l.track, l.start, round(l.period, 6) AS period, round(l.origin, 6) AS origin, round(refit, 6) AS refit FROM l JOIN ro ON ro.track = l.track")
def lattice_fit(spark, sf):
    rows = paced(spark, sf)
    return _rounded(T.refit_origin(rows, T.fit_lattice(rows, "track"), "track"), ["track", "start"], period=6, origin=6, refit=6)


_FREE = """{n} AS (SELECT track, t, i, t0, n, CASE WHEN n >= 8 AND kept >= 8 AND slope > 0 THEN slope ELSE free END AS free FROM (SELECT *, regr_slope(CASE WHEN keep THEN t END, x) OVER w AS slope, count(*) FILTER (keep) OVER w AS kept
  FROM (SELECT *, abs(t - (t0 + x * free)) < free / 4 AS keep FROM (SELECT *, round_even((t - t0) / free, 0) AS x FROM {m}) a) b WINDOW w AS (PARTITION BY track)) z)"""


@query(f"""WITH {W}, f0 AS (SELECT p.track, t, i, first_value(t) OVER (PARTITION BY p.track ORDER BY i) AS t0, count(*) OVER (PARTITION BY p.track) AS n, period AS free FROM p JOIN l ON l.track = p.track),
{", ".join(_FREE.format(n=f"f{k}", m=f"f{k - 1}") for k in (1, 2, 3))},
u AS (SELECT track, any_value(free) AS free, max(t) + 1 AS duration FROM f3 GROUP BY 1),
v AS (SELECT *, list_filter([0, 1, 2], lambda d: abs(60 / round_even(60 / free, d) - free) * duration / free / 2 <= 0.005)[1] AS digits FROM u)
SELECT track, round(free, 6) AS free, round(CASE WHEN digits IS NULL THEN 60 / free ELSE round_even(60 / free, digits) END, 4) AS bpm, digits FROM v""")
def tempo_chosen(spark, sf):
    rows = paced(spark, sf)
    free = T.free_period(rows, T.fit_lattice(rows, "track"), "track")
    ends = rows.groupBy("track").agg((F.max("t") + 1).alias("duration"))
    out = free.join(ends, "track").withColumn("c", T.choose_bpm(F.col("free"), F.col("duration")))
    return out.select("track", F.round("free", 6).alias("free"), F.round("c.bpm", 4).alias("bpm"), F.col("c.digits").alias("digits"))


_PHASES = """ph AS (SELECT DISTINCT track, per, round_even(t % per, 4) AS phase FROM {src}),
er AS (SELECT h.track, h.phase, list_sort(list(abs((s.t - phase + s.per / 2) - floor((s.t - phase + s.per / 2) / s.per) * s.per - s.per / 2))) AS e FROM ph h JOIN {src} s ON s.track = h.track GROUP BY 1, 2),
rk AS (SELECT track, phase, list_avg(e[1:greatest(1, CAST(round_even(len(e) * CAST(0.95 AS DOUBLE), 0) AS BIGINT))]) AS score, list_aggregate(e, 'quantile_cont', 0.95) AS p95 FROM er),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score, 9), round(p95, 9), phase) AS r FROM rk) q WHERE r = 1)"""


@query(f"WITH {P}, s AS (SELECT track, t, CAST(0.47 AS DOUBLE) AS per FROM p), {_PHASES.format(src='s')} SELECT track, round(score, 4) AS score FROM bp")
def phase_ranked(spark, sf):
    rows = paced(spark, sf).groupBy("track").agg(F.array_sort(F.collect_list("t")).alias("t"))
    best = rows.select("track", T.ranked_phases(F.col("t"), F.lit(0.47))[0].alias("b"))
    return best.select("track", F.round("b.score", 4).alias("score"))


@query(f"""WITH {P}, g AS (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS g FROM p), m AS (SELECT track, count(*) AS beats, quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 2) AS period FROM g GROUP BY 1 HAVING count(*) >= 4),
s AS (SELECT p.track, t, beats, period * 2 AS per FROM p JOIN m ON m.track = p.track WHERE 60 / period > 100 AND 60 / (period * 2) BETWEEN 50 AND 100), {_PHASES.format(src='s')}
SELECT bp.track, any_value(beats) AS beats, round(any_value(60 / per), 4) AS bpm, round(any_value(per), 5) AS period FROM bp JOIN s ON s.track = bp.track GROUP BY 1""")
def anchor_fallback(spark, sf):
    out = T.fallback_anchor(paced(spark, sf), "track", 50.0, 100.0)
    return _rounded(out, ["track", "beats"], bpm=4, period=5)


_LOCAL = f"""{P}, n AS (SELECT track, count(*) AS n FROM p GROUP BY 1),
a AS (SELECT p.track, i AS centre, t AS mid, least(n, 64) AS size, greatest(0, least(i - least(n, 64) // 2, n - least(n, 64))) AS start FROM p JOIN n ON n.track = p.track WHERE i % 4 = 0 AND n >= 8),
q AS (SELECT a.track, centre, mid, start, p.t, p.i - start AS x, regr_slope(p.t, p.i - start) OVER w AS period, regr_intercept(p.t, p.i - start) OVER w AS phase FROM a JOIN p ON p.track = a.track AND p.i >= start AND p.i < start + size WINDOW w AS (PARTITION BY a.track, centre)),
lf AS (SELECT track, centre, any_value(mid) AS t, any_value(start) AS start, any_value(period) AS period, max(t) - min(t) AS span, quantile_cont(abs(t - phase - period * x), 0.95) AS p95 FROM q GROUP BY 1, 2 HAVING any_value(period) > 0 AND 60 / any_value(period) BETWEEN 70 AND 150)"""


def _local(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = paced(spark, sf)
    centres = rows.where("i % 4 = 0").withColumnRenamed("i", "centre")
    return centres, T.local_fits(rows, centres, "track")


@query(f"WITH {_LOCAL} SELECT track, centre, start, round(period, 5) AS period, round(p95, 5) AS p95 FROM lf")
def tempo_local(spark, sf):
    return _rounded(_local(spark, sf)[1], ["track", "centre", "start"], period=5, p95=5)


@query(f"""WITH {_LOCAL}, st AS (SELECT *, (CAST(0.65 AS DOUBLE) * (centre % 7) / 7 + CAST(0.35 AS DOUBLE) * (centre % 5) / 5) AS strength FROM lf),
sc AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY strength * span / (p95 + 0.005) ** 1.5 DESC, p95, t) AS rank FROM st) SELECT track, centre, rank, round(strength, 6) AS strength FROM sc WHERE rank <= 4""")
def downbeat_posts(spark, sf):
    centres, fits = _local(spark, sf)
    rows = fits.join(centres, ["track", "centre"]).withColumns({"activation": F.col("centre") % 7 / 7.0, "energy": F.col("centre") % 5 / 5.0})
    return T.post_candidates(rows, "track").select("track", "centre", "rank", F.round("strength", 6).alias("strength"))


@query(f"""WITH {W}, z AS (SELECT ro.track, period, refit, max(t) AS duration FROM ro JOIN p ON p.track = ro.track GROUP BY 1, 2, 3),
y AS (SELECT *, greatest(0, greatest(0, refit) - floor((greatest(0, refit) + 0.25 * period) / period) * period) AS first FROM z)
SELECT track, round(first, 5) AS first, CAST(floor((duration - first) / period) + 1 AS INTEGER) AS beats, round(first + floor((duration - first) / period) * period, 5) AS last FROM y""")
def grid_laid(spark, sf):
    rows = paced(spark, sf)
    fits = T.refit_origin(rows, T.fit_lattice(rows, "track"), "track").join(rows.groupBy("track").agg(F.max("t").alias("duration")), "track")
    laid = fits.withColumn("first", T.grid_origin(F.col("refit"), F.col("period")))
    laid = laid.withColumn("g", T.grid_beats(F.col("first"), F.col("period"), F.col("duration")))
    return laid.select("track", _scaled(F.col("first"), 5).alias("first"), F.size("g").alias("beats"), _scaled(F.element_at("g", -1), 5).alias("last"))


@query("""SELECT vec_id, round(CAST(embedding[CAST(least(63, round_even(vec_id % 100 / CAST(50 AS DOUBLE) * 50, 0)) AS BIGINT) + 1] AS DOUBLE), 6) AS activation,
  round(least(1, sqrt(list_avg(list_transform(embedding[CAST(greatest(0, round_even((vec_id % 60 / CAST(20 AS DOUBLE) - 0.05) * 20, 0)) AS BIGINT) + 1 : CAST(least(64, round_even((vec_id % 60 / CAST(20 AS DOUBLE) + 0.3) * 20, 0)) AS BIGINT)],
    lambda x: CAST(x AS DOUBLE) * x)))), 6) AS energy FROM embeddings""")
def beat_strengths(spark, sf):
    rows, x = read(spark, sf, "embeddings", "vec_id", "embedding"), F.col("embedding")
    act = T.activation_strength(x, F.col("vec_id") % 100 / F.lit(50.0))
    energy = T.audio_strength(x, F.col("vec_id") % 60 / F.lit(20.0), F.lit(1.0), 20)
    return rows.select("vec_id", F.round(act, 6).alias("activation"), F.round(energy, 6).alias("energy"))
