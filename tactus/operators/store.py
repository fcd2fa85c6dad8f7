"""The catalog's writer: rows against a target's columns, row ids, revision stamps, the version gate, and build counters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that the writer owns, and tables whose rows have an id of their own.
REVISIONS = {"tracks": ("content_revision", "audio_revision", "artwork_revision"), "catalogs": ("revision",)}
WITH_UUID = ("catalogs", "analyses", "catalog_tracks")


def revision_token() -> str:
    """16 random bytes in hex: one for each write."""
    return secrets.token_hex(16)


def insertable(rows: DataFrame, table: str, target: StructType) -> DataFrame:
    """``rows`` as the target has them: a column that it lacks is a ValueError, as is a row without any; revision columns
    are dropped, missing ids allocated, other missing columns null."""
    unknown = [c for c in rows.columns if c not in target.names]
    if unknown:
        raise ValueError(f"unknown columns of {table}: {', '.join(sorted(unknown))}")
    own = [c for c in rows.columns if c not in REVISIONS.get(table, ())]
    if not own:
        raise ValueError(f"rows of {table} without a column")
    out = rows.select(*own)
    if table in WITH_UUID:
        given = F.nullif(F.trim(F.col("uuid").cast("string")), F.lit("")) if "uuid" in own else F.lit(None).cast("string")
        out = out.withColumn("uuid", F.coalesce(given, F.expr("uuid()")))
    kept = [f for f in target if f.name not in REVISIONS.get(table, ())]
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kept])


def stamped(rows: DataFrame, table: str, token: str) -> DataFrame:
    """``rows`` with the write's token in all revision columns."""
    return rows.withColumns({c: F.lit(token) for c in REVISIONS.get(table, ())})


def checked_version(versions: DataFrame, wanted: dict[str, int]) -> None:
    """Raises ValueError unless the version table (name, version) has exactly the wanted ones. It has a row for each name,
    of which those beyond ``wanted`` are not read."""
    have = {r["name"]: r["version"] for r in versions.where(F.col("name").isin(list(wanted))).select("name", "version").collect()}
    for name, version in wanted.items():
        if have.get(name) != version:
            raise ValueError(f"{name} has version {have.get(name)}, not {version}")


def non_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull())


def by_time(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, rows): each key's rows in an order, as one array."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("rows"))


def build_report(tracks: DataFrame) -> DataFrame:
    """One row of counters of (outcome): tracks, written, merged, skipped and those without analysis."""
    count = {c: F.count_if(F.col("outcome") == c).alias(c) for c in ("written", "merged", "skipped", "no_analysis")}
    return tracks.agg(F.count("*").alias("tracks"), *count.values())


def audio_by_name(files: DataFrame) -> DataFrame:
    """(name, path) of (root_order, path) audio files: names of the first root that has them, and in it the last path;
    files below hidden folders do not count."""
    name, shown = F.substring_index("path", "/", -1), ~F.col("path").rlike(r"/\.[^/]+/")
    audio = F.lower("path").rlike(r"\.(mp3|aiff|aif|wav|flac|m4a)$")
    best = F.max_by("path", F.struct(-F.col("root_order"), F.col("path")))
    return files.where(audio & shown).withColumn("name", name).groupBy("name").agg(best.alias("path"))


def audio_path(entries: DataFrame, by_name: DataFrame) -> DataFrame:
    """``entries`` (file_name, stored_path, stored_exists) with audio: the path by name, else a stored one that exists."""
    found = by_name.select(F.col("name").alias("file_name"), F.col("path").alias("_by_name"))
    stored = F.when(F.col("stored_exists"), F.col("stored_path"))
    return entries.join(found, "file_name", "left").withColumn("audio", F.coalesce("_by_name", stored, F.lit(""))).drop("_by_name")


def wanted(entries: DataFrame, prefix: str = "", names: DataFrame | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Entries of sources with a prefix, in an allow-list of file names if there is one, the first ``limit`` by ``order``."""
    out = entries.where(F.col("source").startswith(prefix))
    if names is not None:
        out = out.join(names.select("file_name").distinct(), "file_name", "left_semi")
    return out.orderBy(order).limit(limit) if limit else out


def allow_list(lines: DataFrame) -> DataFrame:
    """(file_name) of lines (value): a JSON array of objects with a path, or plain names; blank lines do not count."""
    scores = F.from_json("value", "array<struct<path: string>>")
    is_json = F.trim("value").startswith("[")
    names = F.when(is_json, F.transform(scores, lambda s: s["path"])).otherwise(F.array(F.trim("value")))
    return lines.select(F.explode(names).alias("file_name")).where("file_name <> ''").distinct()
