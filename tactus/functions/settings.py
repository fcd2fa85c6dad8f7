"""A request's settings and a grid's identity: JSON documents, whose value types and spelling count, so these go through
Arrow batches in Python and not through Spark's JSON functions, which lose both."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from tactus.sources.codecs import canonical

#: Each setting's type, default, group, unit, least, most and step.
SETTINGS = {
    "min_bpm": ("number", 110.0, "grid", "BPM", 40.0, 300.0, None),
    "max_bpm": ("number", 130.0, "grid", "BPM", 40.0, 300.0, None),
    "beats_per_bar": ("integer", 4, "grid", None, 1.0, 16.0, None),
    "origin_refine": ("boolean", True, "grid", None, None, None, None),
    "consensus": ("boolean", True, "recipe", None, None, None, None),
    "arbitrate": ("boolean", True, "recipe", None, None, None, None),
    "arbitrate_min_vote_agreement": ("number", 0.7, "recipe", None, 0.5, 1.0, 0.05),
    "arbitrate_half_beat_slop_ms": ("number", 60.0, "recipe", "ms", None, None, None),
    "consensus_max_bpm_delta": ("number", 0.05, "recipe", "BPM", None, None, None),
    "consensus_max_origin_ms": ("number", 60.0, "recipe", "ms", None, None, None),
    "consensus_max_phase_beats": ("number", 0.5, "recipe", "beats", None, None, None),
    "consensus_min_vote_agreement": ("number", 0.6, "recipe", None, 0.0, 1.0, None),
    "device": ("string", "auto", "runtime", None, None, None, None),
}
_TYPES = {"number": DoubleType(), "integer": LongType(), "boolean": BooleanType(), "string": StringType()}


def _fits(kind: str, value: object) -> bool:
    if kind == "boolean" or isinstance(value, bool):
        return kind == "boolean" and isinstance(value, bool)
    return isinstance(value, {"number": (int, float), "integer": int, "string": str}[kind]) and (kind != "integer" or value >= 0)


def resolved(document: dict) -> tuple[dict, dict]:
    """(settings, document): every setting with its default where the document has none or one of another type, a meter
    outside 1 to 16 as 4; and the document as given with the missing settings filled in."""
    own = {k: document[k] if _fits(kind, document.get(k)) else default for k, (kind, default, *_) in SETTINGS.items()}
    own = {k: float(v) if SETTINGS[k][0] == "number" else v for k, v in own.items()}
    if not 1 <= own["beats_per_bar"] <= 16:
        own["beats_per_bar"] = 4
    return own, {**own, **document}


def schema(devices: list[str] = ()) -> dict[str, dict]:
    """What ``describe`` tells of each setting; what is none is left out."""
    out = {}
    for key, (kind, default, group, unit, least, most, step) in SETTINGS.items():
        told = {"type": kind, "default": default, "group": group, "unit": unit, "minimum": least, "maximum": most, "step": step, "affects_identity": group != "runtime"}
        out[key] = {k: v for k, v in told.items() if v is not None}
    out["device"]["enum"] = ["auto", *devices]
    return out


def with_device(document: dict, device: str) -> dict:
    """The resolved document with the device that ``auto`` became."""
    return {**document, "device": device}


RESOLVED = StructType()
for _key, (_kind, *_) in SETTINGS.items():
    RESOLVED = RESOLVED.add(_key, _TYPES[_kind])
RESOLVED = RESOLVED.add("document", StringType())


@F.pandas_udf(RESOLVED)
def _settings(documents: pd.Series) -> pd.DataFrame:
    rows = []
    for text in documents:
        own, document = resolved(json.loads(text) if text and text.strip() else {})
        rows.append({**own, "document": canonical(document)})
    return pd.DataFrame(rows, columns=RESOLVED.names)


def settings(document: Column) -> Column:
    """A JSON document as a struct of all settings and ``document``, the canonical resolved one."""
    return _settings(document)


def digest(document: object) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


@F.pandas_udf(StringType())
def _identities(recipe: pd.Series, legs: pd.Series, decoder: pd.Series) -> pd.Series:
    return pd.Series([digest({"recipe": r, "legs": json.loads(x), "decoder": json.loads(d)}) for r, x, d in zip(recipe, legs, decoder)])


def identity_hash(recipe: Column, legs: Column, decoder: Column) -> Column:
    """What a grid is identified by: SHA-256 of the canonical recipe, legs and decoder (the last two as JSON)."""
    return _identities(recipe, legs, decoder)


@F.pandas_udf(BooleanType())
def _own_hashes(legs: pd.Series) -> pd.Series:
    out = []
    for text in legs:
        leg = json.loads(text)
        cfg, reported = (leg.get("identity") or {}).get("cfg"), leg.get("cfg_hash")
        out.append(None if cfg is None or not isinstance(reported, str) else digest(cfg) == reported)
    return pd.Series(out, dtype=object)


def cfg_hash_holds(leg: Column) -> Column:
    """Whether a tracker's JSON reports the hash of its own configuration; null if it lacks either."""
    return _own_hashes(leg)
