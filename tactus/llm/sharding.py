"""Sharding by weighted rendezvous hashing of a stable record key, with built-in expressions only.

Each shard draws ``-ln(u) / weight`` for a key, where u in (0, 1) comes from XXH64 of ``key:shard``, and the smallest
draw takes the record. Draws of the old shards do not change when a shard is added, so records move only into the new
one, about its share of them. Only the key and the list of shards decide.

Edge cases: a null key is the key ''; rows with equal keys share a shard; a null text has no bytes and CRC 0; an empty
table gives an empty result. ``slot`` numbers the rows of a shard without gaps from 0, by key bucket, key and CRC. Equal draws
go to the smaller shard; texts of any length count by their bytes and are not moved; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.common import bucket_of, no_null, numbered, table

SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def draw(key: Column, shard: int, weight: float) -> Column:
    """(-ln(u) / weight, shard): XXH64's upper 53 bits, centred in their interval, are u."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f":{shard}"))), 11)
    return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def assign(df: DataFrame, key: str, weights: Sequence[float], added: Sequence[float] = ()) -> DataFrame:
    """``df`` with shard, and grown_shard: where the record goes once shards of the ``added`` weights join."""
    if not weights or min([*weights, *added]) <= 0:
        raise ValueError("every shard needs a weight above zero")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draws = [draw(name, i, w) for i, w in enumerate([*weights, *added])]
    best = df.withColumn("_best", F.array_min(F.array(*draws[: len(weights)])))
    best = best.withColumn("_grown", F.array_min(F.array(F.col("_best"), *draws[len(weights) :])))
    return best.withColumns({"shard": F.col("_best.shard"), "grown_shard": F.col("_grown.shard")}).drop("_best", "_grown")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards under the law ``key``."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    sized = assign(docs, "doc_id", [1.0] * SHARDS, [1.0]).select(
        "doc_id",
        (F.octet_length(no_null("text")) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(no_null("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
        bucket_of(F.col("doc_id")).alias("_bucket"),
    )
    out = numbered(sized, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", bounded_groups=True)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
