"""Queries over signals, cues and event streams, each with the DuckDB SQL of the same rows.

Samples are line items' quantities by supplier, feature frames and byte waves are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.operators import cues, events, waves
from tactus.plans.grids import query, read


def _samples(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rows.select(F.col("l_suppkey").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("j"), (F.col("l_quantity") * 600).alias("v"))


P = "p AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS j, l_quantity * 600 AS v FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM p)"


def _bucket(width: int) -> str:
    return f"""k AS (SELECT track, v, unnest(CASE WHEN n >= {width} THEN [((j + 1) * {width} - 1) // n] ELSE range(CAST(ceil(j * {width} / CAST(n AS DOUBLE)) AS BIGINT), CAST(ceil((j + 1) * {width} / CAST(n AS DOUBLE)) AS BIGINT)) END) AS col FROM n)"""


@query(f'WITH {P}, {_bucket(120)} SELECT track, col AS "column", max(v) AS v FROM k GROUP BY 1, 2')
def wave_bucket_max(spark, sf):
    return waves.bucket_max(_samples(spark, sf), "track", 120)


@query(f"""WITH {P}, {_bucket(400)}, e AS (SELECT track, col, avg((v / CAST(32768 AS DOUBLE)) * (v / CAST(32768 AS DOUBLE))) AS e FROM k GROUP BY 1, 2), h AS (SELECT *, CAST(greatest(1, least(31, round(e * 31))) AS INTEGER) AS h FROM e)
SELECT track, col AS "column", CASE WHEN e > 0 THEN (CASE WHEN h >= 30 THEN 6 WHEN h >= 24 THEN 5 ELSE 4 END) * 32 + h ELSE 0 END AS byte FROM h""")
def wave_mono_energy(spark, sf):
    return waves.mono_energy(_samples(spark, sf), "track", 150)


@query(f"WITH {P}, f AS (SELECT track, j // 20 AS frame, sqrt(avg(v * v)) AS rms FROM p GROUP BY 1, 2) SELECT track, frame, round(greatest(-120, CASE WHEN rms > 0 THEN 20 * log10(rms / max(rms) OVER (PARTITION BY track)) ELSE -120 END), 6) AS db FROM f")
def band_rms_db(spark, sf):
    return waves.band_db(_samples(spark, sf), "track", 20).select("track", "frame", F.round("db", 6).alias("db"))


def _bytes(spark, sf) -> DataFrame:
    """(label, column, lane0..2): embeddings quantised to bytes, one column for each vector of a label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    byte = [F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("embedding")[i].cast("double") * 256 + 128))).cast("int").alias(f"lane{i}") for i in range(3)]
    return read(spark, sf, "embeddings", "vec_id", "embedding", "label").select(F.col("label").alias("track"), (F.row_number().over(order) - 1).alias("column"), *byte)


Y = "y AS (SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col, " + ", ".join(f"CAST(greatest(0, least(255, floor(CAST(embedding[{i + 1}] AS DOUBLE) * 256 + 128))) AS INTEGER) AS lane{i}" for i in range(3)) + " FROM embeddings)"


@query(f'WITH {Y} SELECT track, col AS "column", greatest(lane0, coalesce(CAST(round(lag(lane0) OVER (PARTITION BY track ORDER BY col) * CAST(0.9 AS DOUBLE)) AS INTEGER), 0)) AS held FROM y')
def wave_hold(spark, sf):
    return waves.held(_bytes(spark, sf), "track", "lane0", 0.9).select("track", "column", "held")


@query(f'WITH {Y} SELECT track, col AS "column", CAST(round(lane0 * CAST(0.5 AS DOUBLE) + coalesce(lag(lane0) OVER w, lane0) * CAST(0.45 AS DOUBLE) + coalesce(lead(lane0) OVER w, lane0) * CAST(0.05 AS DOUBLE)) AS INTEGER) AS blended FROM y WINDOW w AS (PARTITION BY track ORDER BY col)')
def wave_blend(spark, sf):
    return waves.blended(_bytes(spark, sf), "track", "lane0", 0).select("track", "column", "blended")


@query(f"""WITH {Y} SELECT track, col AS "column", lane0 & 31 AS height, lane0 >> 5 AS white, lane0 & 15 AS low, ((lane0 * 256 + lane1) >> 13) & 7 AS red, ((lane0 * 256 + lane1) >> 10) & 7 AS green, ((lane0 * 256 + lane1) >> 7) & 7 AS blue, ((lane0 * 256 + lane1) >> 2) & 31 AS tall FROM y""")
def section_fields(spark, sf):
    rows, pair = _bytes(spark, sf), F.col("lane0") * 256 + F.col("lane1")
    one, two, five = waves.fields("PWV3", F.col("lane0")), waves.fields("PWV2", F.col("lane0")), waves.fields("PWV5", pair)
    return rows.select("track", "column", one["height"].alias("height"), one["white"].alias("white"), two["height"].alias("low"), *[five[n].alias(n) for n in ("red", "green", "blue")], five["height"].alias("tall"))


def _compared(spark, sf) -> DataFrame:
    rows = _bytes(spark, sf)
    stepped = rows.select("track", *[F.struct(F.col(f"lane{i}").alias("ref"), F.lead(f"lane{i}").over(Window.partitionBy("track").orderBy("column")).alias("got")).alias(f"p{i}") for i in range(3)])
    pairs = stepped.select("track", F.explode(F.array(*[F.struct(F.lit(f"lane{i}").alias("field"), F.col(f"p{i}.ref").alias("ref"), F.col(f"p{i}.got").alias("got")) for i in range(3)])).alias("x"))
    return waves.compared(pairs.select("track", "x.*").where("got is not null"), ["track", "field"])


C = f"""{Y}, z AS (SELECT track, u.field AS field, u.ref AS ref, u.got AS got FROM (SELECT track, unnest([{', '.join(f"{{'field': 'lane{i}', 'ref': lane{i}, 'got': lead(lane{i}) OVER (PARTITION BY track ORDER BY col)}}" for i in range(3))}]) AS u FROM y) q),
c AS (SELECT track, field, 100 * avg(CASE WHEN ref = got THEN 1.0 ELSE 0.0 END) AS exact, avg(abs(ref - got)) AS mae, CASE WHEN var_pop(ref) > 0 AND var_pop(got) > 0 THEN covar_pop(ref, got) / sqrt(var_pop(ref) * var_pop(got)) ELSE 0 END AS corr, count(*) AS compared FROM z WHERE got IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {C} SELECT track, field, round(exact, 6) AS exact, round(mae, 6) AS mae, round(corr, 6) AS corr, compared FROM c")
def section_compare(spark, sf):
    return _compared(spark, sf).select("track", "field", *[F.round(c, 6).alias(c) for c in ("exact", "mae", "corr")], "compared")


@query(f"WITH {C}, m AS (SELECT track, avg(mae) AS mae FROM c GROUP BY 1) SELECT track, CAST(floor((round(mae, 6) + CAST(0.05 AS DOUBLE)) * 1000 + CAST(0.999 AS DOUBLE)) AS BIGINT) AS floor_thousandths FROM m")
def section_floors(spark, sf):
    mean = _compared(spark, sf).groupBy("track").agg(F.avg("mae").alias("mae"))
    return mean.select("track", F.floor((F.round("mae", 6) + F.lit(0.05)) * 1000 + F.lit(0.999)).alias("floor_thousandths"))


def _frames(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings", "vec_id", "embedding").select(F.expr("vec_id div 256").alias("track"), (F.col("vec_id") % 256).alias("i"), F.posexplode("embedding").alias("channel", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


N = """fr AS (SELECT vec_id // 256 AS track, vec_id % 256 AS i, unnest(embedding) AS v0, generate_subscripts(embedding, 1) AS ch FROM embeddings), fd AS (SELECT track, i, ch, CAST(v0 AS DOUBLE) AS v FROM fr),
st AS (SELECT track, i, ch, avg(v) OVER (PARTITION BY track, ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, avg(v) OVER (PARTITION BY track, ch ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM fd),
di AS (SELECT track, i, sqrt(sum((b - a) * (b - a))) AS d FROM st GROUP BY 1, 2), de AS (SELECT track, i, CASE WHEN i >= 4 AND i < count(*) OVER (PARTITION BY track) - 4 THEN d ELSE 0 END AS d FROM di),
nv AS (SELECT track, i, CASE WHEN max(d) OVER (PARTITION BY track) > 0 THEN d / max(d) OVER (PARTITION BY track) ELSE 0 END AS novelty FROM de),
ph AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i) AS place, count(*) OVER (PARTITION BY track) AS total FROM nv WHERE i % 32 = 0 AND i > 0)"""


@query(f"WITH {N} SELECT track, i, round(novelty, 6) AS novelty FROM nv")
def novelty_curve(spark, sf):
    return cues.novelty(_frames(spark, sf), "track").select("track", "i", F.round("novelty", 6).alias("novelty"))


@query(f"WITH {N} SELECT track, i, place, total FROM ph")
def phrase_candidates(spark, sf):
    return cues.phrases(cues.novelty(_frames(spark, sf), "track"), "track").select("track", "i", "place", "total")


@query(f"WITH {N}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY novelty DESC, i) AS r FROM ph), c AS (SELECT * FROM r WHERE r <= 8) SELECT track, row_number() OVER (PARTITION BY track ORDER BY i) AS slot, i, i // 4 AS bar FROM c")
def cues_novelty(spark, sf):
    return cues.picked(cues.phrases(cues.novelty(_frames(spark, sf), "track"), "track"), "track", "novelty")


@query(f"""WITH {N}, a AS (SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY novelty DESC, i) AS r FROM ph WHERE place <= greatest(1, total // 3)), z AS (SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY novelty DESC, i) AS r FROM ph WHERE place > total - greatest(1, total // 3)),
c AS (SELECT DISTINCT track, i FROM (SELECT * FROM a UNION ALL SELECT * FROM z) u WHERE r <= 4) SELECT track, row_number() OVER (PARTITION BY track ORDER BY i) AS slot, i, i // 4 AS bar FROM c""")
def cues_mix(spark, sf):
    return cues.picked(cues.phrases(cues.novelty(_frames(spark, sf), "track"), "track"), "track", "mix")


@query("""WITH e AS (SELECT user_id AS track, event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), b AS (SELECT track, ms, row_number() OVER (PARTITION BY track ORDER BY ms) - 1 AS i FROM (SELECT DISTINCT track, ms FROM e WHERE event_type <> 'purchase') q),
d AS (SELECT track, event_id AS d, ms FROM e WHERE event_type = 'purchase') SELECT d.track, d.d, arg_min(i, struct_pack(x := abs(b.ms - d.ms), y := i)) AS i FROM d JOIN b ON b.track = d.track GROUP BY 1, 2""")
def downbeat_asof(spark, sf):
    e = read(spark, sf, "events", "user_id", "event_id", "event_type", "ts").select(F.col("user_id").alias("track"), "event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"))
    b = e.where("event_type <> 'purchase'").select("track", "ms").distinct()
    b = b.withColumn("i", (F.row_number().over(Window.partitionBy("track").orderBy("ms")) - 1).cast("long"))
    return cues.nearest_beat(e.where("event_type = 'purchase'").select("track", F.col("event_id").alias("d"), "ms"), b, "track").where("i is not null")


@query("SELECT label, ch, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding) AS v0, generate_subscripts(embedding, 1) - 1 AS ch FROM embeddings) q, LATERAL (SELECT CAST(v0 AS DOUBLE) AS v) r GROUP BY 1, 2")
def embed_window_mean(spark, sf):
    rows = read(spark, sf, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("ch", "v"))
    return rows.groupBy("label", "ch").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def embed_round(spark, sf):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    return read(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("WITH s AS (SELECT conv_id, coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS step FROM conversations) SELECT conv_id, count(*) AS events, count(*) FILTER (step <> 1) AS faults FROM s GROUP BY 1")
def event_seq_check(spark, sf):
    return events.sequence_faults(read(spark, sf, "conversations", "conv_id", "turn"), "conv_id", "turn")


@query("SELECT conv_id, count(*) AS tasks, count(*) FILTER (length(text) < 40) AS failed_tasks, CASE WHEN count(*) FILTER (length(text) < 40) > 0 THEN 'failed' ELSE 'ok' END AS outcome FROM conversations GROUP BY 1")
def item_outcomes(spark, sf):
    rows = read(spark, sf, "conversations", "conv_id", "text").withColumn("bad", F.coalesce(F.char_length("text") < 40, F.lit(False)))
    return events.outcomes(rows, "conv_id", "bad")


@query("""WITH f AS (SELECT conv_id, turn * 150 AS o, CASE WHEN role = 'assistant' THEN 150 ELSE 150 - turn % 2 END AS c FROM conversations), g AS (SELECT *, o <> coalesce(sum(c) OVER (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM f)
SELECT conv_id, count(*) AS frames, CAST(sum(c) AS BIGINT) AS width, NOT bool_or(gap) AS contiguous FROM g GROUP BY 1""")
def frames_contiguous(spark, sf):
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role")
    width = F.when(F.col("role") == "assistant", F.lit(150).cast("long")).otherwise(150 - F.col("turn") % 2)
    return events.contiguous(rows.select("conv_id", (F.col("turn") * 150).alias("o"), width.alias("c")), "conv_id", "o", "c")


@query("SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS identity FROM documents")
def sha_identity(spark, sf):
    return read(spark, sf, "documents", "doc_id", "lang", "source").select("doc_id", F.sha2(F.concat(F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('"}')), 256).alias("identity"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, sf):
    rows = read(spark, sf, "events", "event_type", "props").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(r"SELECT page_id, lower(coalesce(nullif(regexp_extract(url, '_\(([^)]+)\)_', 1), ''), regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''))) AS stem FROM pages")
def stem_key(spark, sf):
    base = F.regexp_replace(F.substring_index("url", "/", -1), r"\.[^.]*$", "")
    return read(spark, sf, "pages", "page_id", "url").select("page_id", F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"_\(([^)]+)\)_", 1), F.lit("")), base)).alias("stem"))


@query("SELECT source, count(*) AS parts FROM (SELECT source, unnest(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS p FROM documents) q GROUP BY 1")
def split_list(spark, sf):
    parts = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, sf, "documents", "source", "text").select("source", F.explode(parts).alias("p")).groupBy("source").agg(F.count("*").alias("parts"))

