"""Catalog files: one SQLite database a track, read and written as bytes, and merged as tables.

A file's bytes are opened in memory, so files may lie in any store that Spark reads, and a reader never locks or changes
one. Files stand in (path, content), as ``spark.read.format("binaryFile")`` gives them; one file is one unit of work.
Tables of many files are one DataFrame each, with the file's path beside the rows.
"""

from __future__ import annotations

import base64
import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegralType, StructType

#: The schema version, the order in which tables are written, and those that hang off an analysis.
VERSION = 1
ORDER = ("artists", "albums", "tracks", "catalogs", "catalog_tracks", "analyses")
CHILDREN = ("beats", "cues", "phrases", "vbr_info", "waveforms", "analysis_files")
_VERSIONS = "CREATE TABLE goose_db_version (id INTEGER PRIMARY KEY AUTOINCREMENT, version_id INTEGER NOT NULL, is_applied INTEGER NOT NULL, tstamp TIMESTAMP DEFAULT (datetime('now')))"


def opened(content: bytes, version: int = VERSION) -> sqlite3.Connection:
    """A catalog in memory; ValueError for bytes that are none or of another version."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content or b"")
        (own,) = db.execute("PRAGMA user_version").fetchone()
        if own != version:
            raise ValueError(f"unsupported catalog schema {own} (supported {version})")
        (applied,) = db.execute("SELECT coalesce(max(version_id), 0) FROM goose_db_version WHERE is_applied").fetchone()
        if applied != version:
            raise ValueError(f"catalog schema/migration mismatch: {own}/{applied}")
    except sqlite3.Error as e:
        db.close()
        raise ValueError(f"not a catalog: {e}") from e
    except ValueError:
        db.close()
        raise
    return db


def read_table(files: DataFrame, table: str, schema: StructType, errors: bool = False) -> DataFrame:
    """(path, _row, columns of ``schema``): the rows of one table of every file, _row in the order of insertion. A column that
    a file lacks is null, a table that it lacks has no rows. A file that is no catalog of this version is an error; with
    ``errors`` it is a row with only ``error``."""
    out = StructType().add("path", "string").add("_row", "long")
    for field in schema:
        out = out.add(field)
    out = out.add("error", "string")
    arrow = to_arrow_schema(out)
    names = schema.names

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            db = opened(content)
        except ValueError as e:
            if not errors:
                raise ValueError(f"{path}: {e}") from e
            return [(path, *[None] * (len(names) + 1), str(e))]
        have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
        if not have:
            return []
        chosen = ", ".join([f'"{c}"' if c in have else "NULL" for c in names])
        found = [(path, *r, None) for r in db.execute(f'SELECT rowid, {chosen} FROM "{table}" ORDER BY rowid')]
        db.close()
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = rows(path, content.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    read = files.select("path", "content").mapInArrow(run, out)
    return read if errors else read.drop("error")


def write_files(tables: dict[str, DataFrame], key: str = "path", order: str = "_row") -> DataFrame:
    """(path, content): a catalog of each path's rows of the tables, in the tables' fixed order and the rows' ``order``.
    Null columns are not written. The file is built in memory and comes whole or not at all."""
    columns, parts = {}, []
    for name, df in tables.items():
        own = [f for f in df.schema if f.name not in (key, order)]
        columns[name] = [(f.name, "INTEGER" if isinstance(f.dataType, IntegralType) else "BLOB" if isinstance(f.dataType, BinaryType) else "TEXT") for f in own]
        plain = [F.base64(f.name).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name) for f in own]
        parts.append(df.select(F.col(key).alias("path"), F.lit(name).alias("name"), F.col(order).cast("long").alias("place"), F.to_json(F.struct(*plain)).alias("row")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    sequence = [*[t for t in ORDER if t in columns], *[t for t in columns if t not in ORDER]]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute(_VERSIONS)
        db.executemany("INSERT INTO goose_db_version (version_id, is_applied) VALUES (?, 1)", [(0,), (VERSION,)])
        db.execute(f"PRAGMA user_version = {VERSION}")
        for name in sequence:
            db.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {kind}' for c, kind in columns[name]) + ")")
            kinds = dict(columns[name])
            for text in pdf[pdf["name"] == name].sort_values("place", kind="stable")["row"]:
                row = {c: base64.b64decode(v) if kinds[c] == "BLOB" else v for c, v in json.loads(text).items()}
                if row:
                    db.execute(f'INSERT INTO "{name}" (' + ", ".join(f'"{c}"' for c in row) + ") VALUES (" + ", ".join("?" * len(row)) + ")", list(row.values()))
        db.commit()
        content = db.serialize()
        db.close()
        return pd.DataFrame({"path": [key[0]], "content": [content]})

    return rows.groupBy("path").applyInPandas(build, "path string, content binary")


def merged(existing: dict[str, DataFrame], incoming: dict[str, DataFrame], key: str = "path", order: str = "_row") -> dict[str, DataFrame]:
    """The tables of ``existing`` with what ``incoming`` adds to the same files.

    Only analyses whose (provider, version) a file lacks are added: numbered on from its largest id in their order, none of
    them selected, hung off the file's track. Their children follow with the new number; the source's catalogs and
    observations come along in files that got an analysis. Other tables stay as they are, but for main catalogs.
    """
    kind = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("provider", "version")]
    names = [key, "_provider", "_version"]
    have = existing["analyses"].select(key, *kind).distinct()
    fresh = incoming["analyses"].select("*", *kind).join(have, names, "left_anti").drop("_provider", "_version")
    top = existing["analyses"].groupBy(key).agg(F.max("id").alias("_top"))
    track = existing["tracks"].groupBy(key).agg(F.min_by("uuid", order).alias("_track"))
    fresh = fresh.join(top, key, "left").join(track, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, "id"))
    fresh = fresh.withColumn("_new", (F.coalesce("_top", F.lit(0)) + place).cast("long"))
    numbers = fresh.select(key, F.col("id").alias("analysis_id"), "_new")
    out = dict(existing)
    if "catalogs" in out:
        out["catalogs"] = out["catalogs"].where(~F.col("kind").eqNullSafe("main"))

    def append(name: str, rows: DataFrame) -> None:
        # behind the rows that are there
        last = out[name].groupBy(key).agg(F.max(order).alias("_last")) if name in out else None
        if last is not None:
            rows = rows.join(last, key, "left").withColumn(order, F.col(order) + F.coalesce("_last", F.lit(0))).drop("_last")
            rows = out[name].unionByName(rows, allowMissingColumns=True)
        out[name] = rows

    for name in CHILDREN:
        if name in incoming:
            append(name, incoming[name].join(numbers, [key, "analysis_id"]).withColumn("analysis_id", F.col("_new")).drop("_new"))
    got = fresh.select(key, "_track").distinct()
    if "catalogs" in incoming:
        append("catalogs", incoming["catalogs"].where(~F.col("kind").eqNullSafe("main")).join(got, key).drop("_track"))
    if "catalog_tracks" in incoming:
        append("catalog_tracks", incoming["catalog_tracks"].join(got, key).withColumn("track_uuid", F.col("_track")).drop("_track"))
    new = fresh.withColumns({"id": F.col("_new"), "track_uuid": F.col("_track"), "selected": F.lit(0).cast("long")}).drop("_new", "_top", "_track")
    append("analyses", new)
    return out
