"""Queries over grids and catalogs, each with the DuckDB SQL of the same rows.

The tables hold no music, so stand-ins have the same shape: a track is a user of ``events``, a provider an event type,
a beat an event; catalogs are orders and line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.functions import grid as g
from tactus.operators import catalog, consensus, lattice, score

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """(track, provider, ord, n, tempo, ms) from events."""
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return read(spark, sf, "events", "event_id", "ts", "user_id", "event_type").select(
        F.col("user_id").alias("track"),
        F.col("event_type").alias("provider"),
        F.col("event_id").alias("ord"),
        (F.col("event_id") % 4 + 1).alias("n"),
        (F.lit(11000) + F.col("event_id") % 3 * 100).cast("long").alias("tempo"),
        ms.alias("ms"),
    )


B = "b AS (SELECT user_id AS track, event_type AS provider, event_id AS ord, event_id % 4 + 1 AS n, CAST(11000 + event_id % 3 * 100 AS BIGINT) AS tempo, epoch_us(ts) // 1000 AS ms FROM events)"
G = f"""{B}, g0 AS (SELECT track, provider, arg_min(n, ord) AS fn, arg_min(tempo, ord) AS ft, arg_min(ms, ord) AS first_ms, max(n) AS beats_per_bar, count(*) AS beats, min(tempo) <> max(tempo) AS dynamic,
  min(ms) FILTER (n = 1) AS first_one_ms FROM b GROUP BY 1, 2),
g AS (SELECT track, provider, ft / CAST(100 AS DOUBLE) AS bpm, beats_per_bar, beats, dynamic, first_ms,
  CAST(CASE WHEN fn > 1 AND ft > 0 THEN round(first_ms - (fn - 1) * CAST(60000 AS DOUBLE) / (ft / CAST(100 AS DOUBLE))) ELSE first_ms END AS BIGINT) AS first_downbeat_ms, first_one_ms FROM g0)"""


@query(f"WITH {G} SELECT * FROM g")
def grid_reduce(spark, sf):
    return score.reduce_grids(beats(spark, sf), ["track", "provider"])


def _pairs(spark, sf) -> DataFrame:
    """Purchases' grids as references, clicks' as results."""
    grids = score.reduce_grids(beats(spark, sf), ["track", "provider"])
    ref = grids.where("provider = 'purchase'").select("track", F.col("bpm").alias("ref_bpm"), F.col("beats_per_bar").alias("ref_bar"), F.col("first_downbeat_ms").alias("ref_downbeat_ms"))
    got = grids.where("provider = 'click'").select("track", F.col("bpm").alias("got_bpm"), F.col("beats_per_bar").alias("got_bar"), F.col("first_one_ms").alias("got_downbeat_ms"))
    return ref.join(got, "track", "left")


S = f"""{G}, p AS (SELECT r.track, r.bpm AS ref_bpm, r.beats_per_bar AS ref_bar, r.first_downbeat_ms AS ref_ms, x.bpm AS got_bpm, x.beats_per_bar AS got_bar, x.first_one_ms AS got_ms
  FROM g r LEFT JOIN g x ON x.track = r.track AND x.provider = 'click' WHERE r.provider = 'purchase'),
q AS (SELECT *, got_ms IS NULL OR got_bpm IS NULL AS error, got_bpm - ref_bpm AS bpm_delta, (got_ms - ref_ms) / CAST(1000 AS DOUBLE) / (CAST(60 AS DOUBLE) / ref_bpm) AS tt, CAST(ref_bar AS DOUBLE) AS bar FROM p),
q2 AS (SELECT *, tt - bar * ceil(tt / bar - CAST(0.5 AS DOUBLE)) AS phase_beats FROM q),
q3 AS (SELECT *, CAST(CASE WHEN ref_ms < 0 THEN 0 ELSE round((tt - phase_beats) / bar) END AS BIGINT) AS bars, coalesce(ref_bar = got_bar, false) AS same_meter, got_bpm / ref_bpm AS ratio, abs(phase_beats) AS ap FROM q2),
s AS (SELECT *, coalesce(NOT error AND same_meter AND abs(bpm_delta) <= 0.5 AND ap <= 0.25 AND bars = 0, false) AS pass FROM q3),
sc AS (SELECT *, CASE WHEN pass THEN 'pass' WHEN error THEN 'error' WHEN NOT same_meter THEN 'meter'
  WHEN abs(bpm_delta) > 0.5 THEN CASE WHEN abs(ratio - 2) < 0.02 THEN 'tempo: double' WHEN abs(ratio - 0.5) < 0.005 THEN 'tempo: half'
    WHEN abs(ratio - 1.5) < 0.02 OR abs(ratio - CAST(2 AS DOUBLE) / 3) < 0.01 THEN 'tempo: 3:2' WHEN abs(bpm_delta) <= 2 THEN 'tempo: near (within 2 BPM)' ELSE 'tempo: other' END
  WHEN ap > 0.25 THEN CASE WHEN abs(ap - round(ap)) <= 0.25 AND round(ap) = 2 THEN 'phase: half a bar' WHEN abs(ap - round(ap)) <= 0.25 THEN 'phase: ' || CAST(CAST(round(ap) AS INTEGER) AS VARCHAR) || ' beat(s)'
    WHEN abs(ap - 0.5) <= 0.1 THEN 'phase: half a beat' ELSE 'phase: fraction' END
  WHEN bars <> 0 THEN 'bars: whole bars off' ELSE 'other' END AS class FROM s)"""


@query(f"WITH {S} SELECT track, error, round(bpm_delta, 6) AS bpm_delta, round(phase_beats, 4) AS phase_beats, bars, same_meter, pass, class FROM sc")
def grid_score(spark, sf):
    out = score.score(_pairs(spark, sf))
    return out.select("track", "error", F.round("bpm_delta", 6).alias("bpm_delta"), F.round("phase_beats", 4).alias("phase_beats"), "bars", "same_meter", "pass", "class")


@query(f"WITH {S} SELECT class, count(*) AS n, min(track) AS first_place FROM sc WHERE NOT pass GROUP BY 1")
def grid_score_breakdown(spark, sf):
    return score.breakdown(score.score(_pairs(spark, sf)), "track")


@query(f"WITH {S} SELECT count(*) AS tracks, count(*) FILTER (pass) AS passed, count(*) FILTER (error) AS errors FROM sc")
def grid_score_report(spark, sf):
    return score.report(score.score(_pairs(spark, sf)))


@query(f"""WITH {B}, s AS (SELECT track, provider, (ms - lag(ms) OVER (PARTITION BY track, provider ORDER BY ms, ord)) / CAST(1000 AS DOUBLE) AS d FROM b),
l AS (SELECT track, provider, list_sort(list(d) FILTER (d > 0)) AS ds FROM s GROUP BY 1, 2)
SELECT track, provider, round(ds[len(ds) // 2 + 1], 6) AS period FROM l""")
def grid_period_ruler(spark, sf):
    return score.gap_rulers(beats(spark, sf), ["track", "provider"]).select("track", "provider", F.round("period", 6).alias("period"))


@query(f"WITH {B} SELECT track, provider, coalesce(min(ms) FILTER (n = 1), min(ms)) AS first_downbeat_ms FROM b GROUP BY 1, 2")
def grid_first_downbeat(spark, sf):
    return beats(spark, sf).groupBy("track", "provider").agg(F.coalesce(F.min(F.when(F.col("n") == 1, F.col("ms"))), F.min("ms")).alias("first_downbeat_ms"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) t WHERE r = 1""")
def analysis_top1(spark, sf):
    rows = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return catalog.top_analysis(rows, "l_orderkey", [F.desc("l_quantity"), F.desc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")])


@query("""SELECT o_orderkey, c_name, coalesce(n, 0) AS cues, round(total, 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def index_describe(spark, sf):
    orders, customer = read(spark, sf, "orders", "o_orderkey", "o_custkey"), read(spark, sf, "customer", "c_custkey", "c_name")
    counts = read(spark, sf, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(counts, orders["o_orderkey"] == counts["l_orderkey"], "left")
    return joined.select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("cues"), F.round("total", 2).alias("total"))


@query(f"WITH {B} SELECT provider, count(DISTINCT track) AS grids, count(*) AS beats FROM b GROUP BY 1")
def provider_stats(spark, sf):
    per = beats(spark, sf).groupBy("provider", "track").agg(F.count("*").alias("n"))
    return per.groupBy("provider").agg(F.count("*").alias("grids"), F.sum("n").alias("beats"))


@query(f"WITH {B} SELECT track, count(DISTINCT provider) AS providers FROM b GROUP BY 1 HAVING bool_or(provider = 'purchase') AND count(DISTINCT provider) > 1")
def comparable_tracks(spark, sf):
    per = beats(spark, sf).select("track", "provider").distinct().groupBy("track").agg(F.count("*").alias("providers"), F.max(F.col("provider") == "purchase").alias("has"))
    return per.where("has and providers > 1").drop("has")


@query(f"WITH {G} SELECT track, arg_min(provider, provider) AS provider, arg_min(bpm, provider) AS bpm, arg_min(first_downbeat_ms, provider) AS first_downbeat_ms FROM g WHERE beats > 5 GROUP BY 1")
def refs_first_match(spark, sf):
    grids = score.reduce_grids(beats(spark, sf), ["track", "provider"]).where("beats > 5")
    first = F.min_by(F.struct("provider", "bpm", "first_downbeat_ms"), "provider")
    return grids.groupBy("track").agg(first.alias("x")).select("track", "x.provider", "x.bpm", "x.first_downbeat_ms")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def child_semi_join(spark, sf):
    kept = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.children_of(read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), kept, "l_orderkey")


_MERGE = """inc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'A'), have AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.l_partkey = inc.l_partkey AND have.l_suppkey = inc.l_suppkey))"""


def _merged(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    have, incoming = rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'").drop("l_returnflag")
    return catalog.merge(have, incoming, ["l_partkey", "l_suppkey"], "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query(f"WITH {_MERGE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT max(l_orderkey) FROM have) + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS new_id, 0 AS selected FROM f")
def catalog_merge(spark, sf):
    return _merged(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "new_id", "selected")


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || CAST(l.quality AS VARCHAR) ELSE sha256(coalesce(text, '')) END AS track_id
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def track_id_coalesce(spark, sf):
    labels = read(spark, sf, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = read(spark, sf, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    known = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string")))
    return docs.select("doc_id", F.coalesce(known, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("track_id"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '')), '[^a-z0-9]', '', 'g') AS name FROM pages")
def normalize_name(spark, sf):
    return read(spark, sf, "pages", "page_id", "url").select("page_id", g.normal_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE starts_with(lower(trim(p_type)), lower(trim(split_part(p_type, ' ', 1)))) AND (starts_with(lower(trim(p_name)), 'part') OR starts_with('part', lower(trim(p_name)))) AND trim(p_name) <> ''")
def name_prefix_match(spark, sf):
    rows = read(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return rows.where(catalog.prefix_match(F.col("p_name"), F.lit("part")) & catalog.prefix_match(F.col("p_type"), F.substring_index("p_type", " ", 1))).drop("p_type")


@query("SELECT o_orderkey, coalesce(nullif(c_name, ''), nullif(o_orderpriority, ''), '') AS title, coalesce(c_mktsegment, 'none') AS artist FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def observation_fill(spark, sf):
    orders, customer = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), read(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    return joined.select("o_orderkey", catalog.first_filled(F.col("c_name"), F.col("o_orderpriority")).alias("title"), F.coalesce("c_mktsegment", F.lit("none")).alias("artist"))


_KEYS = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_name"], "part": ["p_partkey", "p_name"], "documents": ["doc_id", "source"], "pages": ["page_id", "url"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) FILTER ({' OR '.join(f"{k} IS NULL OR trim(CAST({k} AS VARCHAR)) = ''" for k in ks)}) AS missing, count(*) AS rows FROM {t}" for t, ks in _KEYS.items()))
def key_validation(spark, sf):
    return catalog.missing_keys({t: (read(spark, sf, t, *ks), ks) for t, ks in _KEYS.items()})


def _legs(spark, sf) -> DataFrame:
    """Clicks' grids as ours, views' as theirs, with a vote."""
    grids = score.reduce_grids(beats(spark, sf), ["track", "provider"])
    ours = grids.where("provider = 'click'").select("track", F.col("bpm").alias("o_bpm"), F.col("beats_per_bar").alias("o_bar"), F.col("first_ms").alias("o_first_ms"), F.col("first_one_ms").alias("o_down_ms"))
    theirs = grids.where("provider = 'purchase'").select("track", F.col("bpm").alias("t_bpm"), F.col("first_ms").alias("t_first_ms"), F.col("first_one_ms").alias("t_down_ms"), (F.col("beats") % 4).alias("vote"), ((F.col("beats") % 10) / F.lit(10.0)).alias("agreement"))
    return ours.join(theirs, "track")


L = f"""{G}, l AS (SELECT o.track, o.bpm AS o_bpm, o.beats_per_bar AS o_bar, o.first_ms AS o_first_ms, o.first_one_ms AS o_down_ms, t.bpm AS t_bpm, t.first_ms AS t_first_ms, t.first_one_ms AS t_down_ms, t.beats % 4 AS vote, (t.beats % 10) / CAST(10 AS DOUBLE) AS agreement,
  CAST(60 AS DOUBLE) / o.bpm AS per FROM g o JOIN g t ON t.track = o.track AND t.provider = 'purchase' WHERE o.provider = 'click')"""


def _reason_sql(shift: str) -> str:
    d, ph = f"(t_first_ms - o_first_ms - {shift}) / CAST(1000 AS DOUBLE)", f"((t_down_ms - o_down_ms - {shift}) / CAST(1000 AS DOUBLE) / per)"
    return f"""concat_ws('; ', CASE WHEN abs(o_bpm - t_bpm) > 0.05 THEN 'bpm' END, CASE WHEN abs(({d} - round({d} / per) * per) * 1000) > 60 THEN 'origin' END,
  CASE WHEN abs({ph} - o_bar * ceil({ph} / o_bar - CAST(0.5 AS DOUBLE))) > 0.5 THEN 'downbeat' END)"""


_HALF = "CASE WHEN abs(o_bpm - t_bpm) <= 0.05 AND abs(abs(((t_first_ms - o_first_ms) / CAST(1000 AS DOUBLE) - round((t_first_ms - o_first_ms) / CAST(1000 AS DOUBLE) / per) * per) * 1000) - per * 500) <= 60 THEN t_first_ms - o_first_ms END"


@query(f"WITH {L} SELECT track, {_reason_sql('0')} AS reasons FROM l")
def consensus_compare(spark, sf):
    return _legs(spark, sf).select("track", consensus.reasons(F.lit(0)).alias("reasons"))


@query(f"WITH {L} SELECT track, {_HALF} AS shift_ms FROM l")
def half_beat_shift(spark, sf):
    return _legs(spark, sf).select("track", consensus.half_beat_shift().alias("shift_ms"))


@query(f"WITH {L} SELECT track, CASE WHEN vote <> 0 AND agreement >= 0.7 THEN vote END AS relabel_beats, CASE WHEN vote <> 0 AND agreement >= 0.6 THEN CASE WHEN vote > o_bar // 2 THEN vote - o_bar ELSE vote END END AS vote_beats FROM l")
def phase_relabel(spark, sf):
    folded = F.when(F.col("vote") > F.floor(F.col("o_bar") / 2), F.col("vote") - F.col("o_bar")).otherwise(F.col("vote"))
    return _legs(spark, sf).select("track", consensus.voted(g.RELABEL_AGREEMENT).alias("relabel_beats"), F.when(consensus.voted(g.DISPUTE_AGREEMENT).isNotNull(), folded).alias("vote_beats"))


@query(f"""WITH {L}, h AS (SELECT *, {_HALF} AS shift_ms FROM l), r AS (SELECT *, {_reason_sql('coalesce(shift_ms, 0)')} AS reasons FROM h),
v AS (SELECT *, CASE WHEN reasons = '' AND vote <> 0 AND agreement >= 0.7 THEN vote END AS relabel_beats FROM r),
d AS (SELECT *, concat_ws('; ', nullif(reasons, ''), CASE WHEN relabel_beats IS NULL AND vote <> 0 AND agreement >= 0.6 THEN 'downbeat vote ' || CAST(CASE WHEN vote > o_bar // 2 THEN vote - o_bar ELSE vote END AS VARCHAR) END) AS dispute FROM v)
SELECT track, shift_ms, relabel_beats, dispute, CASE WHEN dispute = '' THEN 'agreed' ELSE 'disputed' END AS verdict FROM d""")
def arbitrate_verdict(spark, sf):
    return consensus.arbitrated(_legs(spark, sf)).select("track", "shift_ms", "relabel_beats", "dispute", "verdict")


@query(f"WITH {B}, m AS (SELECT *, min(ms) OVER () AS lo FROM b) SELECT track, ord, greatest(ms - lo - 3600000, 0) AS ms, (n - 1 - 1 + 4) % 4 + 1 AS n FROM m")
def grid_shift_relabel(spark, sf):
    rows = beats(spark, sf)
    low = rows.agg(F.min("ms").alias("lo"))
    listed = rows.join(F.broadcast(low)).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("ms") - F.col("lo")).alias("ms"), "n"))).alias("b"))
    moved = listed.select("track", F.posexplode(g.shift(F.col("b"), F.lit(-3600000))).alias("place", "x"))
    return moved.select("track", "x.ord", "x.ms", g.relabel(F.col("x.n"), F.col("place"), F.lit(1), F.lit(4)).alias("n"))


def _timed(spark, sf) -> DataFrame:
    rows = beats(spark, sf)
    rows = rows.withColumn("t", (F.col("ms") - F.min("ms").over(Window.partitionBy("track"))) / F.lit(1000.0))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("track").orderBy("t", "ord")) - 1)


T = f"{B}, t AS (SELECT *, (ms - min(ms) OVER (PARTITION BY track)) / CAST(1000 AS DOUBLE) AS t FROM b), i AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, ord) - 1 AS i, count(*) OVER (PARTITION BY track) AS n_all FROM t)"
_WIN = f"""{T}, w AS (SELECT track, i, t, s * 8 AS start, i - s * 8 AS x FROM i, range(0, 100000) r(s) WHERE s * 8 <= i AND s * 8 > i - 16 AND s * 8 <= n_all - 16),
f AS (SELECT track, start, regr_slope(t, x) AS period, regr_intercept(t, x) AS origin, max(t) - min(t) AS span FROM w GROUP BY 1, 2),
e AS (SELECT w.track, w.start, quantile_cont(abs(t - origin - period * x), 0.5) AS median_error, quantile_cont(abs(t - origin - period * x), 0.95) AS p95_error FROM w JOIN f ON f.track = w.track AND f.start = w.start GROUP BY 1, 2)"""


@query(f"WITH {_WIN} SELECT f.track, f.start, round(period, 2) AS period, round(median_error, 0) AS median_error, round(p95_error, 0) AS p95_error, round(span, 3) AS span FROM f JOIN e ON e.track = f.track AND e.start = f.start WHERE period > 0")
def linear_window(spark, sf):
    fits = lattice.fitted(lattice.windows(_timed(spark, sf), "track"), "track")
    return fits.select("track", "start", *[F.round(c, d).alias(c) for c, d in (("period", 2), ("median_error", 0), ("p95_error", 0), ("span", 3))])


@query(f"""WITH {_WIN}, a AS (SELECT f.track, f.start, CAST(60 AS DOUBLE) / period AS bpm, span / (p95_error + CAST(0.005 AS DOUBLE)) ** CAST(1.5 AS DOUBLE) AS score FROM f JOIN e ON e.track = f.track AND e.start = f.start WHERE period > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, start) AS r FROM a WHERE bpm BETWEEN 0 AND 150) SELECT track, start, round(bpm, 6) AS bpm FROM r WHERE r = 1""")
def anchor_windows(spark, sf):
    fits = lattice.fitted(lattice.windows(_timed(spark, sf), "track"), "track")
    return lattice.anchored(fits, "track", 0.0).select("track", "start", F.round("bpm", 6).alias("bpm"))


@query(f"""WITH {T}, c AS (SELECT track, i, t, n_all, unnest(CASE WHEN n_all < 32 THEN [] WHEN n_all < 64 THEN [n_all] WHEN n_all < 128 THEN [64] ELSE [64, 128] END) AS size FROM i),
w AS (SELECT track, size, i, t, unnest(list_filter(range(0, i + 1, 8), lambda s: s > i - size AND s <= n_all - size)) AS start FROM c),
f AS (SELECT track, size, start, regr_slope(t, i - start) AS period, regr_intercept(t, i - start) AS origin, max(t) - min(t) AS span FROM w GROUP BY 1, 2, 3),
e AS (SELECT w.track, w.size, w.start, quantile_cont(abs(t - origin - period * (i - w.start)), 0.95) AS p95_error FROM w JOIN f ON f.track = w.track AND f.size = w.size AND f.start = w.start GROUP BY 1, 2, 3),
a AS (SELECT f.track, f.size, f.start, CAST(60 AS DOUBLE) / period AS bpm, span / (p95_error + CAST(0.005 AS DOUBLE)) ** CAST(1.5 AS DOUBLE) AS score FROM f JOIN e ON e.track = f.track AND e.size = f.size AND e.start = f.start WHERE period > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, size, start) AS r FROM a WHERE bpm BETWEEN 0 AND 150) SELECT track, size, start, round(bpm, 6) AS bpm FROM r WHERE r = 1""")
def anchor_reference(spark, sf):
    fits = lattice.fitted(lattice.anchor_windows(_timed(spark, sf), "track"), "track")
    return lattice.anchored(fits, "track", 0.0).select("track", "size", "start", F.round("bpm", 6).alias("bpm"))


@query(f"WITH {T}, s AS (SELECT track, (lead(t, 8) OVER (PARTITION BY track ORDER BY i) - t) / 8 AS step FROM i) SELECT track, round(quantile_cont(step, 0.5), 4) AS period, count(*) AS spans FROM s WHERE step > 0 GROUP BY 1")
def consensus_period(spark, sf):
    return lattice.consensus_period(_timed(spark, sf), "track").select("track", F.round("period", 4).alias("period"), "spans")


@query(f"WITH {T} SELECT track, ord, round(abs((t - 0.25 + 0.25) % CAST(0.5 AS DOUBLE) - 0.25), 4) AS residual FROM i")
def circular_residual(spark, sf):
    return _timed(spark, sf).select("track", "ord", F.round(lattice.residual(F.col("t"), F.lit(0.25), F.lit(0.5)), 4).alias("residual"))


@query(f"""WITH {T}, v AS (SELECT track, CAST(round_even(t / CAST(0.7 AS DOUBLE), 0) AS BIGINT) % 4 AS vote, count(*) AS n FROM i WHERE n = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, vote) AS r, sum(n) OVER (PARTITION BY track) AS total FROM v)
SELECT track, vote, round(n / total, 6) AS agreement FROM r WHERE r = 1""")
def phase_vote(spark, sf):
    downs = _timed(spark, sf).where("n = 1").withColumns({"origin": F.lit(0.0), "period": F.lit(0.7)})
    return lattice.phase_vote(downs, "track").select("track", "vote", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {T}, x AS (SELECT track, ord, i, sum(CASE WHEN provider = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY i) AS p FROM i)
SELECT track, ord, (row_number() OVER (PARTITION BY track, p ORDER BY i) - 1) % 4 + 1 AS n FROM x""")
def legacy_tuples(spark, sf):
    rows = _timed(spark, sf).withColumn("down", F.col("provider") == "signup").drop("n")
    return lattice.numbered_from_downbeats(rows, "track").select("track", "ord", "n")


@query("SELECT event_id, CASE WHEN value > 0 THEN CASE WHEN u BETWEEN 70 AND 150 THEN round(u, 4) END END AS bpm FROM (SELECT event_id, value, up / 2 ** greatest(0, ceil(log2(up / 150))) AS u FROM (SELECT event_id, value, value * 2 ** greatest(0, ceil(log2(70 / value))) AS up FROM events WHERE value > 0) a) b")
def fallback_tempo(spark, sf):
    rows = read(spark, sf, "events", "event_id", "value").where("value > 0")
    return rows.select("event_id", F.round(lattice.octave_folded(F.col("value")), 4).alias("bpm"))


_CAMELOT = ", ".join(f"('{k}', '{v}')" for k, v in g.camelot_table().items())


@query(f"""WITH k(name, code) AS (VALUES {_CAMELOT}), x AS (SELECT n_nationkey, lower(['c','d','e','f','g','a','b','f#','db','eb'][n_nationkey % 10 + 1] || CASE n_nationkey % 3 WHEN 0 THEN ' major' WHEN 1 THEN ' minor' ELSE ' x' END) AS name FROM nation)
SELECT n_nationkey, coalesce(code, '') AS code FROM x LEFT JOIN k ON k.name = x.name""")
def camelot_map(spark, sf):
    tonic = F.element_at(F.array(*map(F.lit, ["C", "D", "E", "F", "G", "A", "B", "F#", "Db", "Eb"])), (F.col("n_nationkey") % 10 + 1).cast("int"))
    mode = F.when(F.col("n_nationkey") % 3 == 0, " major").when(F.col("n_nationkey") % 3 == 1, " minor").otherwise(" x")
    return read(spark, sf, "nation", "n_nationkey").select("n_nationkey", g.camelot(F.concat(tonic, mode)).alias("code"))
