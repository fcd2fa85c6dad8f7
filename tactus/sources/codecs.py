"""Binary and text formats: tagged section files, feature files, canonical JSON, indexes, event logs, checksum lists."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The feature file's header and shape.
FEATURES = struct.Struct("<4sHHIBBHI32s12x")
FRAME_HZ, BANDS, COEFFICIENTS = 20, 3, 20


def features(data: bytes) -> dict:
    """A feature file's frames, duration_ms, digest and values (channels x frames); ValueError if it is not one."""
    if len(data) < FEATURES.size:
        raise ValueError("too short for a header")
    magic, version, hz, frames, bands, count, reserved, duration, digest = FEATURES.unpack_from(data)
    if (magic, version, hz, bands, count, reserved) != (b"DC7F", 1, FRAME_HZ, BANDS, COEFFICIENTS, 0) or not frames or not duration:
        raise ValueError("not a version 1 file of this shape")
    if any(data[FEATURES.size - 12 : FEATURES.size]) or len(data) != FEATURES.size + 2 * frames * (bands + count):
        raise ValueError("wrong size")
    values = np.frombuffer(data, "<f2", offset=FEATURES.size).reshape(bands + count, frames)
    if not np.isfinite(values).all():
        raise ValueError("values that are not finite")
    return {"frames": frames, "duration_ms": duration, "digest": digest.hex(), "values": values.astype(np.float32)}


def packed_features(values: np.ndarray, duration_ms: int, digest: bytes) -> bytes:
    """The file of channels x frames values."""
    return FEATURES.pack(b"DC7F", 1, FRAME_HZ, values.shape[1], BANDS, COEFFICIENTS, 0, duration_ms, digest) + np.ascontiguousarray(values, "<f2").tobytes()


def read_features(files: DataFrame) -> DataFrame:
    """(path, frames, duration_ms, values, error) of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                try:
                    f = features(content or b"")
                    rows.append((path, f["frames"], f["duration_ms"], f["values"].tolist(), None))
                except ValueError as e:
                    rows.append((path, None, None, None, str(e)))
            types = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.float32())), pa.string())
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "frames", "duration_ms", "values", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, frames int, duration_ms long, values array<array<float>>, error string")


def sections(data: bytes) -> list[tuple[int, str, int, bytes]]:
    """(offset, fourcc, header length, whole section) of a big-endian tagged file.

    A fourcc that cannot be printed ends the sections; a length that cannot be is a ValueError.
    """
    if len(data) < 28 or data[:4] != b"PMAI":
        raise ValueError("not a section file")
    at, end = struct.unpack_from(">II", data, 4)
    if max(at, end) > len(data):
        raise ValueError("lengths beyond the file")
    out = []
    while at + 12 <= end and all(0x20 <= c <= 0x7E for c in data[at : at + 4]):
        head, size = struct.unpack_from(">II", data, at + 4)
        if size < 12 or at + size > len(data):
            raise ValueError(f"section at {at} has length {size}")
        out.append((at, data[at : at + 4].decode(), head, data[at : at + size]))
        at += size
    return out


def read_sections(files: DataFrame, errors: bool = False) -> DataFrame:
    """(path, off, fourcc, len_header, raw) of (path, content). With ``errors`` a file that is none gives a row with its
    ``error``, else no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*[batch.column(i).to_pylist() for i in (0, 1)]):
                try:
                    rows += [(path, *s, None) for s in sections(content or b"")]
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "off", "fourcc", "len_header", "raw", "error"])

    out = files.select("path", "content").mapInArrow(run, "path string, off long, fourcc string, len_header long, raw binary, error string")
    return out if errors else out.where("error is null").drop("error")


def big_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes at a place (from 0) of a binary column."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def audio_path(raw: Column) -> Column:
    """The UTF-16 text of a path section, as long as its length field says, up to its first NUL."""
    size = F.least(big_endian(raw, 12, 4), F.octet_length(raw).cast("long") - 16).cast("int")
    return F.substring_index(F.decode(F.substring(raw, F.lit(17), size), "UTF-16BE"), "\u0000", 1)


def body(raw: Column) -> Column:
    """A section after its name and lengths; null if there is nothing."""
    return F.when(F.octet_length(raw) > 12, F.substring(raw, F.lit(13), F.octet_length(raw)))


#: For each waveform section whether an entry's bytes stand first, whether a rate follows, and the header.
WAVEFORMS = {"PWAV": (False, False, 8), "PWV2": (False, False, 8), "PWV3": (True, True, 12), "PWV4": (True, False, 12), "PWV5": (True, True, 12), "PWV6": (True, False, 8), "PWV7": (True, True, 12)}


def waveforms(sections_: DataFrame) -> DataFrame:
    """The waveform sections of (path, off, fourcc, raw): path, off, fourcc, entry_bytes (0 if unknown), entries, rate and
    data; sections too short for their header give no row."""
    own, out = body(F.col("raw")), {}
    columns = {"entry_bytes": F.lit(0), "entries": F.lit(0), "rate": F.lit(0), "header": F.lit(None).cast("int")}
    for fourcc, (sized, rated, header) in WAVEFORMS.items():
        here = F.col("fourcc") == fourcc
        stated = big_endian(own, 0, 4) if sized else F.lit(0)
        values = {
            "entry_bytes": F.when(stated != 0, stated).otherwise(1 if fourcc in ("PWAV", "PWV2") else 0),
            "entries": big_endian(own, 4 if sized else 0, 4),
            "rate": big_endian(own, 8, 2) if rated else F.lit(0),
            "header": F.lit(header),
        }
        out = {k: F.when(here, v).otherwise((out or columns)[k]) for k, v in values.items()}
    rows = sections_.withColumns(out).where(F.octet_length(own) >= F.col("header"))
    return rows.select("path", "off", "fourcc", "entry_bytes", "entries", "rate", F.substring(own, F.col("header") + 1, F.octet_length(own)).alias("data"))


def first_section(sections_: DataFrame, fourcc: str) -> DataFrame:
    """Each file's first section of a name."""
    return sections_.where(F.col("fourcc") == fourcc).groupBy("path").agg(F.min_by(F.struct("off", "len_header", "raw"), "off").alias("s")).select("path", F.lit(fourcc).alias("fourcc"), "s.*")


def band_scales(sections_: DataFrame) -> DataFrame:
    """(path, low, mid, high): the last six bytes of each file's PWVC section; no row without them."""
    rows = first_section(sections_, "PWVC").withColumn("p", payload(F.col("raw"), F.col("len_header"))).where("octet_length(p) >= 6")
    last = F.substring(F.col("p"), F.octet_length("p") - 5, F.lit(6))
    return rows.select("path", *[big_endian(last, 2 * k, 2).alias(c) for k, c in enumerate(("low", "mid", "high"))])


def folded_sections(sections_: DataFrame, folder: Column, order: Column) -> DataFrame:
    """(folder, fourcc, raw): the last section of each name among a folder's files, by ``order``."""
    return sections_.withColumns({"folder": folder, "_order": order}).groupBy("folder", "fourcc").agg(F.max_by("raw", F.struct("_order", -F.col("off"))).alias("raw"))


def payload(raw: Column, len_header: Column) -> Column:
    """A section after its header."""
    return F.when(len_header <= F.octet_length(raw), F.substring(raw, len_header + 1, F.octet_length(raw)))


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and floats in their shortest form: what identities are hashed from. Numbers
    that are not finite are a ValueError."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def plain_base64(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


INDEX = "format int, updated string, tracks array<struct<id: string, title: string, source: string, grids: array<struct<provider: string, version: string, bpm: double, first_downbeat_ms: int, beats_per_bar: int, beats: int, selected: boolean>>>>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each track of an index file."""
    return spark.read.schema(INDEX).option("multiLine", True).json(path).select("format", "updated", F.explode("tracks").alias("t")).select("format", "updated", "t.*")


def write_index(tracks: DataFrame, path: str, updated: str) -> None:
    """One JSON line for each track, sorted by id inside range partitions, so that a large index is written in parallel."""
    tracks.withColumn("updated", F.lit(updated)).repartitionByRange("id").sortWithinPartitions("id").write.json(path)


EVENT = "seq long, event string, id string, stage string, task string, status string, code string, items string, columns int, offset long"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log of JSON lines; lines that are not JSON are dropped. ``items`` is a list or a count by its event."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    ids = F.when(F.col("event") == "batch_started", F.from_json("items", "array<string>"))
    return rows.withColumns({"item_ids": ids, "item_count": F.when(F.col("event") == "batch_done", F.expr("try_cast(items as int)"))})


def read_checksums(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(platform, sha256, file) of a checksum list: archives named prefix-os-arch.tar.gz."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(words) == 2).select(words[0].alias("sha256"), F.regexp_replace(words[1], r"^\*", "").alias("file"))
    found = F.regexp_extract("file", rf"^{prefix}-([^-]+)-([^-]+)\.tar\.gz$", 0) != ""
    platform = F.regexp_replace(F.regexp_extract("file", rf"^{prefix}-([^-]+-[^-]+)\.tar\.gz$", 1), "-", "/")
    return rows.where(found).select(platform.alias("platform"), "sha256", "file")


def start_time(text: Column) -> Column:
    """Seconds from 0 to 1 that a prober printed; '' and 'N/A' are 0; anything else is an error."""
    first = F.trim(F.regexp_replace(text, r"[,\s]+$", ""))
    value = F.when(first.isin("", "N/A"), F.lit(0.0)).otherwise(first.try_cast("double"))
    return F.when(value.between(0, 1), value).otherwise(F.raise_error(F.concat(F.lit("start time "), text)).cast("double"))
