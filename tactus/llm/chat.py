"""Chat formatting by event-sourced reconstruction, with built-in expressions only.

A log has (conv_id, turn, seq, event, role, text). Partitioned by conversation and sorted by sequence, events fold
into final messages: ``message`` opens a message, ``delta`` appends to the open one of its turn, ``edit`` replaces its
text, ``regenerate`` discards it and starts again with its own text. A template then renders the messages of a
conversation: ``<|im_start|>role\\n`` + escaped text + ``<|im_end|>\\n``. Inside texts a backslash quotes a backslash
and splits every control string, so no text can forge a mark and reading back gives the exact text.

Everything of a conversation meets in one row, as its rendered text must; nothing else is gathered.

Edge cases: null texts are empty; a null role reads back as ''; roles other than plain words are written in hex; rows
of equal turn go by sequence, role and text, and repeated rows are repeated turns; a message has the last role that any of
its events names, so edits and regenerations may leave it out; texts of any length are rendered whole; other columns, whatever
their names, are not read; a delta, edit or regeneration
without a message before it opens one; null conv_ids form one conversation; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.common import no_null, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: What an escape splits, behind its first character: marks of this template and of other common ones.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|<?/?SYS>>)"
PLAIN_ROLE = "^[A-Za-z0-9_.-]+$"
#: The contract's extra conversation.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    return F.when(role.rlike(PLAIN_ROLE), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(no_null(role), "UTF-8"))))


def _role_in(name: Column) -> Column:
    return F.when(name.startswith("="), F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")).otherwise(name)


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log."""
    events = log.select("conv_id", "turn", "seq", F.coalesce(F.col("event"), F.lit("message")).alias("event"), "role", no_null("text").alias("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns(
        {
            "message": F.sum((F.col("event") == "message").cast("long")).over(so_far),
            "version": F.sum(F.col("event").isin("message", "edit", "regenerate").cast("long")).over(so_far),
            "place": F.row_number().over(order),
        }
    )
    last = F.max("version").over(Window.partitionBy("conv_id", "turn", "message"))
    text = F.when(F.col("version") == F.col("_last"), F.struct("place", "text"))  # null otherwise: not collected
    pieces = F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"])
    named = F.when(F.col("role").isNotNull(), F.col("place"))
    final = events.withColumn("_last", last).groupBy("conv_id", "turn", "message")
    return final.agg(F.max_by("role", named).alias("role"), F.array_join(pieces, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask has (start, end, loss) of each text in ``formatted``, in code points."""
    parts = messages.withColumns({"head": F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")), "body": escape(no_null("text"))})
    order = Window.partitionBy("conv_id").orderBy("turn", "message")
    before = F.coalesce(F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"place": F.row_number().over(order), "start": before + F.char_length("head")})
    end = F.col("start") + F.char_length("body")
    span = F.struct("start", end.alias("end"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    turns = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("out"), span.alias("span")))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, place, role, text, loss): the turns that ``formatted`` holds.

    ``loss`` is true where the mask's span stands exactly over the text found.
    """
    turns = F.filter(F.split("formatted", END.replace("|", r"\|")), lambda t: t != "")
    rows = formatted.select("conv_id", F.char_length("formatted").alias("formatted_chars"), F.posexplode(F.arrays_zip(turns.alias("t"), F.col("mask").alias("m"))).alias("place", "x"))
    rows = rows.select("conv_id", "formatted_chars", "place", F.col("x.t").alias("t"), F.col("x.m").alias("m"))
    order = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("t") + len(END)).over(order), F.lit(0))
    cut = F.locate("\n", F.col("t"))
    rows = rows.withColumns({"at": at, "cut": cut})
    under = F.col("m.loss") & (F.col("m.start") == F.col("at") + F.col("cut")) & (F.col("m.end") == F.col("at") + F.char_length("t"))
    role = _role_in(F.expr(f"substring(t, {len(START) + 1}, cut - {len(START) + 1})"))
    return rows.select("conv_id", "formatted_chars", "place", role.alias("role"), unescape(F.expr("substring(t, cut + 1)")).alias("text"), under.alias("loss"))


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each row is a message event."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("event"), "role", "text")


def digests(turns: DataFrame) -> DataFrame:
    ordered = turns.groupBy("conv_id").agg(F.max("formatted_chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("place", "role", "text", "loss"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["text"]), "")
    out = ordered.select("conv_id", F.size("t").cast("long").alias("n_turns"), whole.alias("whole"), masked.alias("masked"), "formatted_chars")
    return out.select("conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and the probe, read back from their rendered form."""
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return digests(read_back(render(fold(as_log(rows.union(probe))))))


_ESCAPED = r"regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2', 'g')"
_ROLE = f"CASE WHEN regexp_matches(role, '{PLAIN_ROLE}') THEN role ELSE '=' || hex(encode(coalesce(role, ''))) END"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM range(2) r(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS masked,
  CAST(sum({len(START) + 1 + len(END)} + length({_ROLE}) + length({_ESCAPED})) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars FROM g"""
