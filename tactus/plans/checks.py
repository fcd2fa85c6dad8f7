"""Queries over invariants, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.operators import checks
from tactus.plans.grids import B, S, T, _pairs, _timed, query, read


@query(f"""WITH {T}, l AS (SELECT track, n, ms, lag(n) OVER w AS pn, lag(ms) OVER w AS pm FROM i WINDOW w AS (PARTITION BY track ORDER BY i))
SELECT track, count(*) FILTER (NOT n BETWEEN 1 AND 4) AS outside, count(*) FILTER (pn IS NOT NULL AND n <> pn % 4 + 1) AS jumps, count(*) FILTER (pm IS NOT NULL AND ms < pm) AS back FROM l GROUP BY 1""")
def grid_check(spark, sf):
    return checks.grid_faults(_timed(spark, sf), "track")


@query(f"""WITH {B}, r AS (SELECT track, provider, ms, row_number() OVER (PARTITION BY track, provider ORDER BY ms, ord) - 1 AS i FROM b WHERE provider IN ('click', 'purchase')),
x AS (SELECT * FROM r WHERE provider = 'click' AND i < 8), y AS (SELECT * FROM r WHERE provider = 'purchase' AND i < 8)
SELECT coalesce(x.track, y.track) AS track, coalesce(x.i, y.i) AS i, x.ms AS left_ms, y.ms AS right_ms, y.ms - x.ms AS delta FROM x FULL JOIN y ON x.track = y.track AND x.i = y.i""")
def grid_diff(spark, sf):
    from pyspark.sql import Window

    from tactus.plans.grids import beats

    order = Window.partitionBy("track", "provider").orderBy("ms", "ord")
    rows = beats(spark, sf).withColumn("i", F.row_number().over(order) - 1)
    return checks.side_by_side(rows.where("provider = 'click'"), rows.where("provider = 'purchase'"), "track")


@query(f"WITH {S} SELECT track, round(tt - round(tt / bar) * bar, 4) AS folded, coalesce(abs(bpm_delta) <= 0.05, false) AS same_tempo FROM q2 WHERE NOT error")
def conformance_tier(spark, sf):
    from tactus.functions import grid as g

    p = _pairs(spark, sf).where("got_downbeat_ms is not null and got_bpm is not null")
    beats = (F.col("got_downbeat_ms") - F.col("ref_downbeat_ms")) / F.lit(1000.0) / (60.0 / F.col("ref_bpm"))
    same = F.coalesce(F.abs(F.col("got_bpm") - F.col("ref_bpm")) <= g.CONFORMANCE_BPM, F.lit(False))
    return p.select("track", F.round(checks.conformance_fold(beats, F.col("ref_bar").cast("double")), 4).alias("folded"), same.alias("same_tempo"))


@query("SELECT page_id, regexp_matches(lower(url || CASE page_id % 3 WHEN 0 THEN '.MP3' WHEN 1 THEN '.flac' ELSE '' END), '\\.(mp3|aiff|aif|wav|flac|m4a)$') AS audio FROM pages")
def audio_files(spark, sf):
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".MP3").when(F.col("page_id") % 3 == 1, ".flac").otherwise(""))
    return read(spark, sf, "pages", "page_id", "url").select("page_id", checks.is_audio(name).alias("audio"))


@query("""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n FROM conversations GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n > 1) AS repeated_ids, count(*) FILTER (trim(id) = '') AS blank_ids, CAST(0 AS BIGINT) AS without_tasks, sum(n) BETWEEN 1 AND 64 AND count(*) FILTER (n > 1) = 0 AS valid FROM p""")
def request_check(spark, sf):
    return checks.request_faults(read(spark, sf, "conversations", "conv_id", "role").select(F.col("conv_id").cast("string").alias("id"), F.array("role").alias("tasks")))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 OR (role = 'assistant' AND turn >= 2) THEN 'run' ELSE 'audio_missing' END AS outcome FROM conversations")
def runnable_tasks(spark, sf):
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role")
    task = F.when(F.col("role") == "assistant", "cues").otherwise("grid")
    return checks.runnable(rows.select("conv_id", "turn", task.alias("task"), (F.col("turn") % 2 == 0).alias("has_audio"), F.col("turn").alias("inputs"))).select("conv_id", "turn", "outcome")
