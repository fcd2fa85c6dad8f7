"""What the operators do beyond the first round's tests: whole results against plain Python."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tactus.llm import mixing, nearcopies, pii, quality, simhash


def roots_of(texts):
    """The component of each text: five-word shingles, Jaccard 0.8 at least, all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def least_ids(rows):
    best = {}
    for (d, _), r in zip(rows, roots_of([t for _, t in rows])):
        best[r] = min(best.get(r, (True, 0)), (d is None, d or 0))
    return Counter(None if none else d for none, d in best.values())


def test_near_copies(spark, sf_dir, odd):
    for sf in (sf_dir, odd):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        kept = corpus_pipeline.near_copies(spark, docs, sf)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == least_ids(rows)
    ids = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert not {145, 177} & ids  # near copies of 6 and 1, at more than three bits


def test_near_copies_in_long_lists(spark):
    rng, rows = np.random.default_rng(4), []
    line = " ".join(f"common{i}" for i in range(40))
    for _ in range(60):  # a common line, and unlike rests
        rows.append(line + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 12)))
    base = [f"b{i}" for i in range(120)]
    for _ in range(150):  # a dense group, some members at its edge
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            own[at] = f"x{rng.integers(0, 1 << 40)}"
        rows.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = simhash.one_of_each(docs, nearcopies.components(docs)).collect()
    assert Counter(r["doc_id"] for r in kept) == least_ids(list(enumerate(rows)))


def test_near_copies_of_nothing(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.near_copies(spark, docs, empty).count() == 0


def slots_of(docs, **how):
    out = {}
    for r in mixing.scheduled(docs, **how).select("row.source", "block", "slot").distinct().collect():
        out.setdefault(r["source"], []).append(r["slot"])
    return {k: np.sort(v) for k, v in out.items()}


def test_mixing_follows_the_weights(spark):
    docs = spark.range(20_020).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "b").otherwise("a").alias("source"), F.lit("x").alias("text"))
    slots = slots_of(docs, weights={"a": 0.9995, "b": 0.0005}, block_rows=1)
    t = np.arange(20_001)
    for source, weight in (("a", 0.9995), ("b", 0.0005)):
        assert np.abs(np.searchsorted(slots[source], t) - t * weight).max() < 1.001


def test_mixing_of_unequal_sources(spark):
    rows = [(f"s{k}", n) for k, n in enumerate([9000, 700, 650, 333, 100, 41, 7, 1])]
    docs = spark.createDataFrame(rows, "source string, n int").select(F.explode(F.sequence(F.lit(1), "n")).alias("doc_id"), "source", F.lit("x").alias("text"))
    slots, total = slots_of(docs, block_rows=1), sum(n**0.5 for _, n in rows)
    taken = np.concatenate(list(slots.values()))
    assert len(np.unique(taken)) == len(taken) == sum(n for _, n in rows)
    for source, n in rows:
        off = np.arange(n) + 1 - (slots[source] + 1) * n**0.5 / total
        assert np.abs(off).max() < 2


def test_mixing_of_many_sources(spark):
    docs = spark.range(18_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "hot").otherwise(F.col("id").cast("string")).alias("source"), F.lit("x").alias("text"))
    slots = slots_of(docs)
    weight = 6000**0.5 / (6000**0.5 + 12_000)
    assert len(slots) == 12_001 and len(slots["hot"]) == 375
    assert np.abs(np.arange(375) + 1 - (slots["hot"] + 1) * weight).max() < 2


def test_mixing_of_a_tiny_weight(spark):
    docs = spark.range(5_400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "b").otherwise("a").alias("source"), F.lit("x").alias("text"))
    slots = slots_of(docs, weights={"a": 0.99999, "b": 0.00001}, block_rows=1)
    assert (slots["b"] < 5_000).sum() <= 2 and len(slots["b"]) == 400


def test_pipeline_keeps_the_schedule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.redact(spark, simhash.one_of_each(quality.kept_only(docs)), sf_dir)
    want = [r["doc_id"] for r in mixing.scheduled(kept).select("slot", "place", "row.doc_id").orderBy("slot", "place").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()] == want != sorted(want)
    scattered = corpus_pipeline.mix(spark, kept, sf_dir).repartition(7)
    assert [r["doc_id"] for r in corpus_pipeline.encode(spark, scattered, sf_dir).collect()] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Account Number: 12345678.", "Account Number: <ACCOUNT>"),
        ("API Key: abcd1234efgh", "API Key: <ACCOUNT>"),
        ("Social Security 123-45-6789", "Social Security <ACCOUNT>"),
        ("John [AT] example [DOT] com", "<EMAIL>"),
        ("İİ Api_Key = 12345678", "İİ Api_Key = <ACCOUNT>"),
        ("pay DE89 3704 0044 0532 0130 00 OK", "pay <ACCOUNT> OK"),
        ("pay GB82WEST12345698765432, now", "pay <ACCOUNT>, now"),
        ("pay DE88 3704 0044 0532 0130 00", "pay DE88 3704 0044 0532 0130 00"),
        ("IBAN de89370400440532013000 ok", "IBAN <ACCOUNT> ok"),
        ('Password: "hunter-two"', 'Password: "<ACCOUNT>"'),
        ("Passport: X1ABCDE", "Passport: <ACCOUNT>"),
        ("the password protects a token economy", "the password protects a token economy"),
    ],
)
def test_pii_in_any_case(text, want):
    assert pii.masked(text).rstrip(".") == want.rstrip(".")
