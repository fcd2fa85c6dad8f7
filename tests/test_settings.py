"""Settings and identities against their published defaults and spellings."""

import hashlib
import json

from pyspark.sql import functions as F

from tactus.functions import settings as S


def test_defaults_and_types():
    own, document = S.resolved({})
    assert own == document and (own["min_bpm"], own["max_bpm"], own["beats_per_bar"], own["device"], own["consensus_max_bpm_delta"]) == (110.0, 130.0, 4, "auto", 0.05)
    given = {"min_bpm": "90", "max_bpm": 140, "beats_per_bar": 17, "arbitrate": 0, "consensus": False, "device": None, "mine": [1]}
    own, document = S.resolved(given)
    assert (own["min_bpm"], own["max_bpm"], own["beats_per_bar"], own["arbitrate"], own["consensus"], own["device"]) == (110.0, 140.0, 4, True, False, "auto")
    assert {k: document[k] for k in given} == given and len(document) == 14
    assert [S.resolved({"beats_per_bar": x})[0]["beats_per_bar"] for x in (0, 1, 16, -3, 3.0, True)] == [4, 1, 16, 4, 4, 4]
    assert S.with_device(document, "mps")["device"] == "mps"


def test_schema():
    told = S.schema(["cpu"])
    assert len(told) == 13 and told["device"] == {"type": "string", "default": "auto", "group": "runtime", "affects_identity": False, "enum": ["auto", "cpu"]}
    assert told["arbitrate_min_vote_agreement"] == {"type": "number", "default": 0.7, "group": "recipe", "minimum": 0.5, "maximum": 1.0, "step": 0.05, "affects_identity": True}


def test_columns(spark):
    cfg = {"b": 1.0, "a": {"y": [1e-05, 4], "x": "é"}}
    text = '{"a":{"x":"é","y":[1e-05,4]},"b":1.0}'
    good = {"identity": {"cfg": cfg}, "cfg_hash": hashlib.sha256(text.encode()).hexdigest()}
    rows = [(None, json.dumps(good)), ('{"max_bpm":150}', json.dumps({**good, "cfg_hash": "x"})), (" ", json.dumps({"cfg_hash": "x"}))]
    df = spark.createDataFrame(rows, "d string, leg string")
    got = df.select(S.settings(F.col("d")).alias("s"), S.cfg_hash_holds(F.col("leg")).alias("h"), S.identity_hash(F.lit("v2"), F.lit('{"leg":"x"}'), F.lit('{"f": 1.0}')).alias("i")).collect()
    assert [r["s"]["max_bpm"] for r in got] == [130.0, 150.0, 130.0] and [r["h"] for r in got] == [True, False, None]
    assert json.loads(got[1]["s"]["document"])["max_bpm"] == 150
    assert got[0]["i"] == hashlib.sha256(b'{"decoder":{"f":1.0},"legs":{"leg":"x"},"recipe":"v2"}').hexdigest()
