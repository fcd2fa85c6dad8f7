"""Values of catalog rows: loose strings and numbers, paths, beat tuples, blobs and match keys, as Column expressions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def row_string(value: Column) -> Column:
    """Any value as a string without white space around it; '' for null."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def row_int64(value: Column) -> Column:
    """A whole number, or null for anything else."""
    return value.try_cast("bigint")


def as_int64(value: Column) -> Column:
    return F.coalesce(row_int64(value), F.lit(0))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def ms(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("bigint")


def path_of_uri(uri: Column) -> Column:
    """The decoded path of a file:// URI; '' for any other, or one that cannot be parsed."""
    path = F.call_function("try_parse_url", uri, F.lit("PATH"))
    return F.when(uri.startswith("file://"), F.coalesce(F.call_function("try_url_decode", F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit(""))).otherwise("")


def beat_tuples(beats: Column) -> Column:
    """ARRAY<ARRAY<BIGINT>> as JSON; null as an empty list."""
    return F.to_json(F.coalesce(beats, F.array().cast("array<array<bigint>>")))


def read_beat_tuples(value: Column) -> Column:
    """[number, tempo, ms] of each beat: null for blank text, an error for other malformed text; short tuples are filled
    with 0, and what follows the third number is left out."""
    parsed = F.from_json(value, "array<array<bigint>>", {"mode": "FAILFAST"})
    return F.when(F.trim(value) != "", F.transform(parsed, lambda t: F.array(*[F.coalesce(F.get(t, k), F.lit(0)) for k in range(3)])))


def from_base64(value: Column) -> Column:
    """Base64 with or without padding and line ends; null for any other sign."""
    plain = F.regexp_replace(value, "[=\r\n]", "")
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plain.rlike("^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1), F.unbase64(whole))


def scales_bytes(low: Column, mid: Column, high: Column) -> Column:
    """Three display scales as big-endian pairs of bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 4, "0") for x in (low, mid, high)]))


@F.pandas_udf(StringType())
def _match_keys(artist: pd.Series, album: pd.Series, title: pd.Series, ext: pd.Series) -> pd.Series:
    # composed characters need Unicode tables, which Spark's functions lack
    marks = {ord(c): f"\\u{ord(c):04x}" for c in "<>&  "}
    out = []
    for row in zip(artist, album, title, ext):
        parts = [unicodedata.normalize("NFC", x) for x in row[:3]]
        out.append(json.dumps([1, *parts, row[3]], ensure_ascii=False, separators=(",", ":")).translate(marks))
    return pd.Series(out)


def file_match_key(artist: Column, album: Column, title: Column, file_name: Column, file_path: Column) -> Column:
    """JSON [1, artist, album, title, extension] with composed characters; null where one of them is missing."""
    name = F.when(row_string(file_name) != "", row_string(file_name)).otherwise(row_string(file_path))
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    parts = [row_string(x) for x in (artist, album, title)]
    there = (parts[0] != "") & (parts[1] != "") & (parts[2] != "") & (ext != "")
    return F.when(there, _match_keys(*parts, ext))
