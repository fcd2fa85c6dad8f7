"""Queries of the protocol and the catalog's writer, each with the DuckDB SQL of the same rows. Items are orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions import settings
from tactus.operators import protocol, store
from tactus.plans.grids import query, read
from tactus.sources import catalogs


@query("""SELECT user_id AS batch, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  '{"event":"item_error","id":"' || event_id || '","task":"' || event_type || '","code":"audio_missing","message":"no audio","retryable":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS line FROM events""")
def event_lines(spark, sf):
    rows = protocol.numbered(read(spark, sf, "events", "event_id", "ts", "user_id", "event_type").withColumnRenamed("user_id", "batch"), "batch", ["ts", "event_id"])
    e = protocol.error(F.col("event_id").cast("string"), F.col("event_type"), F.lit("audio_missing"), F.lit("no audio"), F.col("event_id") % 2 == 0)
    return rows.select("batch", "event_id", "seq", protocol.lines(e).alias("line"))


@query("""WITH i AS (SELECT o_custkey AS batch, o_orderkey AS id, o_orderstatus AS s FROM orders), t AS (SELECT DISTINCT l_orderkey AS id, l_shipdate IS NOT NULL AND l_returnflag = 'A' AS d FROM lineitem),
o AS (SELECT DISTINCT batch FROM i WHERE s = 'P') SELECT i.batch, CAST(i.id AS VARCHAR) AS id, u.task, 'engine_crashed' AS code, 'engine exited' AS message, true AS retryable
  FROM i, (VALUES ('grid'), ('key')) u(task) WHERE batch NOT IN (SELECT batch FROM o) AND NOT EXISTS (SELECT 1 FROM t WHERE t.id = i.id AND d)""")
def crash_errors(spark, sf):
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    done = read(spark, sf, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    ended = orders.where("o_orderstatus = 'P'").select("batch", F.lit("batch_done").alias("event"), F.lit("").alias("id"))
    events = orders.join(done, "id").select("batch", F.lit("item_done").alias("event"), "id").union(ended)
    items = orders.select("batch", "id", F.array(F.lit("grid"), F.lit("key")).alias("tasks"))
    return protocol.crashed(items, events, "engine exited").drop("event")


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 60 + value END AS bpm, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 4 ELSE 3 END END AS bar, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 20 ELSE 520 END END AS first_beat_ms,
  CASE WHEN event_id % 7 <> 0 THEN 1020 END AS first_downbeat_ms, CASE WHEN event_id % 7 <> 0 THEN event_id % 4 END AS vote, CASE WHEN event_id % 7 <> 0 THEN 'v1' END AS version FROM events""")
def leg_grids(spark, sf):
    """Trackers' JSON written from the table's numbers, and parsed: every seventh has no beats."""
    rows = read(spark, sf, "events", "event_id", "value")
    grid = F.struct((F.col("value") + 60).alias("bpm"), F.when(F.col("event_id") % 3 != 0, 3).alias("beats_per_bar"), F.when(F.col("event_id") % 5 == 0, 20).alias("first_beat_ms"))
    beats = F.array(F.struct(F.lit(3).alias("beat_number"), F.lit(520).alias("time_ms")), F.struct(F.lit(1).alias("beat_number"), F.lit(1020).alias("time_ms")))
    value = F.to_json(F.struct(grid.alias("grid"), F.when(F.col("event_id") % 7 != 0, beats).alias("beats"), (F.col("event_id") % 4).alias("bt_phase_vote")))
    out = rows.select("event_id", protocol.leg_grid(value, "v1").alias("g"))
    return out.select("event_id", F.col("g.bpm").alias("bpm"), F.col("g.beats_per_bar").alias("bar"), F.col("g.first_beat_ms").alias("first_beat_ms"), F.col("g.first_downbeat_ms").alias("first_downbeat_ms"), F.col("g.phase_vote").alias("vote"), F.col("g.algo_version").alias("version"))


@query("SELECT count(*) AS tracks, count(*) FILTER (o_orderstatus = 'F') AS written, count(*) FILTER (o_orderstatus = 'O') AS merged, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS no_analysis FROM orders")
def build_report(spark, sf):
    status = F.col("o_orderstatus")
    rows = read(spark, sf, "orders", "o_orderstatus").select(F.when(status == "F", "written").when(status == "O", "merged").when(status == "P", "skipped").otherwise("no_analysis").alias("outcome"))
    return store.build_report(rows)


@query("""WITH f AS (SELECT o_custkey % 40 AS root, '/r' || o_custkey % 40 || CASE WHEN o_orderkey % 11 = 0 THEN '/.x/' ELSE '/a/' END || o_orderkey || '/t' || o_orderkey % 100 || CASE WHEN o_orderkey % 3 = 0 THEN '.mp3' ELSE '.txt' END AS path, o_orderkey FROM orders),
g AS (SELECT *, 't' || o_orderkey % 100 || '.mp3' AS name FROM f WHERE o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0) SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY root, path DESC) AS r FROM g) q WHERE r = 1""")
def audio_names(spark, sf):
    k, root = F.col("o_orderkey"), F.col("o_custkey") % 40
    folder = F.when(k % 11 == 0, "/.x/").otherwise("/a/")
    path = F.concat(F.lit("/r"), root.cast("string"), folder, k.cast("string"), F.lit("/t"), (k % 100).cast("string"), F.when(k % 3 == 0, ".mp3").otherwise(".txt"))
    return store.audio_by_name(read(spark, sf, "orders", "o_orderkey", "o_custkey").select(root.alias("root_order"), path.alias("path")))


@query("""SELECT c_custkey AS id, coalesce(n_name, CASE WHEN c_custkey % 2 = 0 THEN '/stored/' || c_custkey ELSE '' END) AS audio FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 WHERE c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%'""")
def audio_paths(spark, sf):
    entries = read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("file_name"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("/stored/"), F.col("c_custkey").cast("string")).alias("stored_path"), (F.col("c_custkey") % 2 == 0).alias("stored_exists")
    )
    names = read(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("path"))
    asked = store.wanted(entries, "A").union(store.wanted(entries, "B"))
    return store.audio_path(asked, names).select("id", "audio")


@query("SELECT c_custkey AS id, c_name AS name, 'tok' AS content_revision, 'tok' AS audio_revision, 'tok' AS artwork_revision, CAST(NULL AS BIGINT) AS tempo FROM customer")
def rows_stamped(spark, sf):
    rows = read(spark, sf, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("content_revision"))
    target = spark.createDataFrame([], "id long, name string, tempo long, content_revision string, audio_revision string, artwork_revision string").schema
    return store.stamped(store.insertable(rows, "tracks", target), "tracks", "tok")


@query("SELECT CAST(o_custkey % 50 AS VARCHAR) AS path, count(*) AS tracks, count(DISTINCT o_orderkey) AS ids, CAST(sum(o_orderkey % 1000) AS BIGINT) AS tempos, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def catalog_round_trip(spark, sf):
    """Fifty catalogs written as SQLite files, and read back."""
    rows = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    tracks = rows.select((F.col("o_custkey") % 50).cast("string").alias("path"), F.col("o_orderkey").alias("_row"), F.col("o_orderkey").cast("string").alias("uuid"), F.col("o_orderstatus").alias("genre"), (F.col("o_orderkey") % 1000).alias("tempo"))
    found = catalogs.read_table(catalogs.write_files({"tracks": tracks}), "tracks", tracks.drop("path", "_row").schema)
    return found.groupBy("path").agg(F.count("*").alias("tracks"), F.count_distinct("uuid").alias("ids"), F.sum("tempo").alias("tempos"), F.count_distinct("genre").alias("kinds"))


@query("""WITH a AS (SELECT l_orderkey % 97 AS path, l_partkey AS id, l_linenumber AS row, l_suppkey % 20 AS provider, l_returnflag AS version, l_quantity AS q, l_orderkey FROM lineitem),
e AS (SELECT * FROM a WHERE l_orderkey % 3 = 0), i AS (SELECT * FROM a WHERE l_orderkey % 3 = 1),
f AS (SELECT path, count(*) AS fresh FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = i.path AND e.provider = i.provider AND e.version = i.version) GROUP BY 1)
SELECT CAST(e.path AS VARCHAR) AS path, count(*) + coalesce(any_value(fresh), 0) AS analyses, CAST(max(id) + coalesce(any_value(fresh), 0) AS BIGINT) AS top, count(*) AS selected FROM e LEFT JOIN f ON f.path = e.path GROUP BY 1""")
def catalog_merged(spark, sf):
    """Analyses of one part of the lines merged into catalogs of another."""
    rows = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag")
    made = rows.select(
        "l_orderkey", (F.col("l_orderkey") % 97).cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("_row"), F.col("l_partkey").alias("id"),
        (F.col("l_suppkey") % 20).cast("string").alias("provider"), F.col("l_returnflag").alias("version"), F.lit(1).cast("long").alias("selected"), F.lit("t").alias("track_uuid"),
    )
    old, new = (made.where(f"l_orderkey % 3 = {k}").drop("l_orderkey") for k in (0, 1))
    tracks = old.select("path", F.lit(1).alias("_row"), F.lit("t").alias("uuid")).distinct()
    out = catalogs.merged({"tracks": tracks, "analyses": old}, {"analyses": new})["analyses"]
    return out.groupBy("path").agg(F.count("*").alias("analyses"), F.max("id").alias("top"), F.sum("selected").alias("selected"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 OR k NOT BETWEEN 1 AND 16 THEN 4 ELSE k END AS bar, CAST(CASE WHEN event_id % 3 = 0 THEN k ELSE 110 END AS DOUBLE) AS low, 130 + 0.0::DOUBLE AS high, event_id % 5 <> 0 AS arbitrate
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e""")
def settings_resolved(spark, sf):
    """Documents made of the events' numbers: some meters as text, some tempos missing."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = read(spark, sf, "events", "event_id", "props").withColumn("k", k)
    given = F.struct(F.when(F.col("event_id") % 4 != 0, F.col("k")).alias("beats_per_bar"), F.when(F.col("event_id") % 3 == 0, F.col("k")).alias("min_bpm"), F.lit("fast").alias("max_bpm"), (F.col("event_id") % 5 != 0).alias("arbitrate"), F.lit(1).alias("other"))
    s = rows.select("event_id", settings.settings(F.to_json(given)).alias("s"))
    return s.select("event_id", F.col("s.beats_per_bar").alias("bar"), F.col("s.min_bpm").alias("low"), F.col("s.max_bpm").alias("high"), F.col("s.arbitrate").alias("arbitrate"))
