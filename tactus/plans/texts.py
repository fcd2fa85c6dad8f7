"""Queries of row values, section bytes and report texts, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions import rows as R
from tactus.operators import catalog, reports, score
from tactus.plans.grids import G, S, _legs, _pairs, beats, query, read
from tactus.sources import codecs


@query("""SELECT event_id, trim('  ' || event_type || ' ') AS name, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, TRY_CAST(event_type AS BIGINT) AS bad,
  CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events""")
def row_values(spark, sf):
    rows = read(spark, sf, "events", "event_id", "event_type", "value", "props")
    return rows.select(
        "event_id",
        R.row_string(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("name"),
        R.as_int64(F.get_json_object("props", "$.k")).alias("k"),
        R.row_int64(F.col("event_type")).alias("bad"),
        R.ms(F.col("value")).alias("ms"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/Music/' || c_name || ' +1.mp3' END AS path FROM customer")
def uri_path(spark, sf):
    rows = read(spark, sf, "customer", "c_custkey", "c_name")
    start = F.when(F.col("c_custkey") % 3 == 0, "http://host/Music/").otherwise("file:///Music/")
    uri = F.concat(start, F.replace(F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("%20")), F.lit("%20+1.mp3"))
    return rows.select("c_custkey", R.path_of_uri(uri).alias("path"))


@query("""SELECT user_id AS track, '[' || string_agg('[' || (event_id % 4 + 1) || ',' || (11000 + event_id % 3 * 100) || ',' || (epoch_us(ts) // 1000) || ']', ',' ORDER BY event_id) || ']' AS tuples, count(*) AS beats,
  CAST(sum(11000 + event_id % 3 * 100) AS BIGINT) AS tempos FROM events WHERE event_id % 7 = 0 GROUP BY 1""")
def beat_tuples(spark, sf):
    """Written as JSON and read back: the feature is the round trip of every seventh beat, which stand for one grid."""
    rows = beats(spark, sf).where("ord % 7 = 0").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("ord", "n", "tempo", "ms"))).alias("b"))
    out = rows.select("track", R.beat_tuples(F.transform("b", lambda b: F.array(b["n"], b["tempo"], b["ms"]))).alias("tuples"))
    back = out.withColumn("t", R.read_beat_tuples(F.col("tuples")))
    return back.select("track", "tuples", F.size("t").cast("long").alias("beats"), F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t[1]).alias("tempos"))


@query("SELECT p_partkey, printf('%04X%04X%04X', p_size, p_size * 7, CAST(p_partkey % 500 AS INTEGER)) AS scales, p_name AS name FROM part")
def blob_bytes(spark, sf):
    rows = read(spark, sf, "part", "p_partkey", "p_size", "p_name")
    packed = R.scales_bytes(F.col("p_size"), F.col("p_size") * 7, F.col("p_partkey") % 500)
    text = F.decode(R.from_base64(F.regexp_replace(codecs.plain_base64(F.encode("p_name", "UTF-8")), "=", "")), "UTF-8")
    return rows.select("p_partkey", F.hex(packed).alias("scales"), text.alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN '[1,"' || p_brand || '","' || replace(p_type, ' ', ' \\u0026 ') || '","' || p_name || '","mp3"]' END AS match_key FROM part""")
def match_keys(spark, sf):
    rows = read(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_name")
    file_name = F.when(F.col("p_partkey") % 5 == 0, F.lit("no extension")).when(F.col("p_partkey") % 2 == 0, F.lit("a.b.MP3"))
    return rows.select("p_partkey", R.file_match_key(F.concat(F.lit(" "), "p_brand"), F.replace("p_type", F.lit(" "), F.lit(" & ")), F.col("p_name"), file_name, F.lit("/x.y/z.mp3")).alias("match_key"))


_LEGS = f"""{G}, l AS (SELECT o.track, o.bpm AS ob, t.bpm AS tb, o.beats_per_bar AS bar, CAST(60 AS DOUBLE) / o.bpm AS per, (t.first_ms - o.first_ms) / CAST(1000 AS DOUBLE) AS d, (t.first_one_ms - o.first_one_ms) / CAST(1000 AS DOUBLE) AS dd,
  t.beats % 4 AS vote, (t.beats % 10) / CAST(10 AS DOUBLE) AS agreement, t.beats_per_bar AS tbar, o.first_ms IS NULL OR t.first_ms IS NULL AS none FROM g o JOIN g t ON t.track = o.track AND t.provider = 'purchase' WHERE o.provider = 'click'),
m AS (SELECT *, (d - round(d / per) * per) * 1000 AS origin, dd / per - bar * ceil(dd / per / bar - CAST(0.5 AS DOUBLE)) AS down FROM l)"""


@query(f"""WITH {_LEGS} SELECT track, concat_ws('; ', CASE WHEN abs(ob - tb) > 0.05 THEN printf('bpm %.2f vs %.2f', ob, tb) END, CASE WHEN abs(origin) > 60 THEN printf('origin %+.0fms', origin) END,
  CASE WHEN abs(down) > 0.5 THEN printf('downbeat %+.1f beats', down) END) AS told FROM m""")
def consensus_told(spark, sf):
    return _legs(spark, sf).select("track", reports.reasons().alias("told"))


@query(f"""WITH {_LEGS} SELECT track, CASE WHEN vote <> 0 AND agreement >= 0.6 THEN printf('downbeat vote %+d beats (%.2f agree)', CAST(CASE WHEN vote > tbar // 2 THEN vote - tbar ELSE vote END AS BIGINT), agreement) END AS dispute FROM l""")
def consensus_vote(spark, sf):
    legs = _legs(spark, sf)
    bars = score.reduce_grids(beats(spark, sf), ["track", "provider"]).where("provider = 'purchase'").select("track", F.col("beats_per_bar").alias("t_bar"))
    return legs.join(bars, "track").select("track", reports.vote_dispute(F.col("vote"), F.col("agreement"), F.col("t_bar")).alias("dispute"))


@query(f"""WITH {S} SELECT track, CASE WHEN error THEN 'ERROR track ' || track || '  no grid' ELSE printf('%s  track %d  bpm %.2f vs %.2f (Δ%+.2f)  meter %d vs %d  phase %+.2f beats  bars %+d  downbeat %d ms  %.1fs', CASE WHEN pass THEN 'pass' ELSE 'FAIL' END,
  track, got_bpm, ref_bpm, bpm_delta, got_bar, ref_bar, phase_beats, bars, got_ms, CAST(5 AS DOUBLE)) END AS line FROM sc""")
def score_lines(spark, sf):
    rows = score.score(_pairs(spark, sf)).withColumns(
        {"path": F.concat(F.lit("track "), F.col("track").cast("string")), "error_text": F.when(F.col("error"), "no grid"), "seconds": F.lit(5.0), "dispute": F.lit("")}
    )
    return rows.select("track", reports.score_line(rows).alias("line"))


@query("""SELECT vec_id, 'PWV5' AS fourcc, CAST(2 AS BIGINT) AS entry_bytes, CAST(vec_id AS BIGINT) AS entries, CAST(150 AS BIGINT) AS rate, CAST(len(embedding) AS INTEGER) AS bytes, CAST(vec_id % 500 AS BIGINT) AS low, CAST(label AS BIGINT) AS high FROM embeddings""")
def section_waveforms(spark, sf):
    """Section files built of the table's numbers, and read: a colour detail of as many bytes as a vector has components,
    and three scales."""
    rows = read(spark, sf, "embeddings", "vec_id", "embedding", "label")

    def number(x, size: int):
        return F.unhex(F.lpad(F.hex(x), 2 * size, "0"))

    def section(name: str, body, head: int):
        return F.concat(F.encode(F.lit(name), "US-ASCII"), number(F.lit(head), 4), number(F.octet_length(body) + 12, 4), body)

    detail = F.concat(number(F.lit(2), 4), number(F.col("vec_id"), 4), number(F.lit(150), 2), number(F.lit(0x305), 2), F.unhex(F.repeat(F.lit("2A"), F.size("embedding"))))
    scales = F.concat(*[number(x, 2) for x in (F.lit(0), F.col("vec_id") % 500, F.lit(7), F.col("label"))])
    tags = F.concat(section("PWV5", detail, 24), section("PWVC", scales, 14))
    files = rows.select(F.col("vec_id").cast("string").alias("path"), F.concat(F.encode(F.lit("PMAI"), "US-ASCII"), number(F.lit(28), 4), number(F.octet_length(tags) + 28, 4), F.unhex(F.repeat(F.lit("00"), 16)), tags).alias("content"))
    found = codecs.read_sections(files)
    waves = codecs.waveforms(found)
    out = waves.join(codecs.band_scales(found), "path")
    return out.select(F.col("path").cast("long").alias("vec_id"), "fourcc", F.col("entry_bytes").cast("long").alias("entry_bytes"), F.col("entries").cast("long").alias("entries"), F.col("rate").cast("long").alias("rate"), F.octet_length("data").alias("bytes"), "low", "high")


@query("SELECT p_partkey, p_partkey % 3 <> 2 AND p_name <> '' AS same FROM part")
def name_prefix_found(spark, sf):
    """Names against their own first letters in capitals, against longer ones, and against others."""
    rows, k, name = read(spark, sf, "part", "p_partkey", "p_name"), F.col("p_partkey"), F.col("p_name")
    asked = F.when(k % 3 == 0, F.upper(F.substring(name, 1, 5))).when(k % 3 == 1, F.concat(F.lit(" "), name, F.lit(" and more"))).otherwise(F.concat(F.lit("~"), name))
    return rows.select("p_partkey", catalog.prefix_match(name, asked).alias("same"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0 ELSE round((c_custkey % 1000) / CAST(1000 AS DOUBLE), 6) END AS seconds FROM customer")
def start_times(spark, sf):
    k = F.col("c_custkey")
    printed = F.when(k % 3 == 0, F.when(k % 2 == 0, "N/A\n").otherwise("")).otherwise(F.format_string("%.6f,\n", k % 1000 / 1000.0))
    return read(spark, sf, "customer", "c_custkey").select("c_custkey", codecs.start_time(printed).alias("seconds"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 1 + s_suppkey % 5 END AS frames, CASE WHEN s_suppkey % 4 <> 0 THEN 50 * (1 + s_suppkey % 5) END AS duration_ms, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(23 * (1 + s_suppkey % 5) AS DOUBLE) END AS total,
  s_suppkey % 4 = 0 AS bad FROM supplier""")
def feature_files(spark, sf):
    """Feature files of ones built of the table's numbers, and read; every fourth lacks its last byte."""
    k = F.col("s_suppkey")
    frames = 1 + k % 5

    def little(x, size: int):
        return F.rpad(F.lpad(F.hex(x), 2, "0"), 2 * size, "0")  # numbers below 256

    head = F.concat(F.lit("444337460100"), little(F.lit(20), 2), little(frames, 4), little(F.lit(3), 1), little(F.lit(20), 1), F.lit("0000"), little(50 * frames, 4), F.lit("AB" * 32), F.lit("00" * 12))
    content = F.unhex(F.concat(head, F.repeat(F.lit("003C"), (23 * frames).cast("int"))))
    cut = F.when(k % 4 == 0, F.substring(content, F.lit(1), F.octet_length(content) - 1)).otherwise(content)
    found = codecs.read_features(read(spark, sf, "supplier", "s_suppkey").select(k.cast("string").alias("path"), cut.alias("content")))
    total = F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), F.col("frames").cast("long").alias("frames"), "duration_ms", total.alias("total"), F.col("error").isNotNull().alias("bad"))
