"""Lattices where the last bits show: figures on the half of a kept decimal, windows of equal spread, beats in any order."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import trackers as T
from tactus.plans import registry, tempos

N = 64


def on_halves(tracks):
    """Lateness in milliseconds of N beats a track, such that the line through them starts on the half of a hundredth of one."""
    late = np.random.default_rng(3).integers(0, 41, (tracks * 200, N))
    fine = 200 * (late * (2 * (2 * N - 1) - 6 * np.arange(N))).sum(1)
    return late[(fine - N * (N + 1)) % (2 * N * (N + 1)) == 0][:tracks]


def test_grid_laid_on_halves(spark, tmp_path):
    late = on_halves(150)
    rows = [(41 * (k * N + i) + int(ms), 60 * i, k) for k, own in enumerate(late) for i, ms in enumerate(own)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id")
    events.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute("SET threads = 1")  # on more, the SQL adds in another order each time
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = db.execute(registry.oracle_sql()["grid_laid"])
    names = [d[0] for d in rel.description]
    got = sorted(tuple(r) for r in tempos.grid_laid(spark, str(tmp_path)).select(*names).collect())
    assert len(got) == 150 and got == sorted(rel.fetchall())


def test_order_of_arrival(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, 0.3 + i * 0.5 + float(rng.normal(0, 0.01))) for k in range(40) for i in range(150)]

    def bits(seed):
        mixed = [rows[j] for j in np.random.default_rng(seed).permutation(len(rows))]
        beats = spark.createDataFrame(mixed, "track long, i long, t double")
        windows = T.fit_windows(beats, "track").select("track", "start", "period", "origin", "spread")
        refit = T.refit_origin(beats, T.fit_lattice(beats, "track"), "track").select("track", "start", "refit")
        return sorted(map(tuple, windows.collect())), sorted(map(tuple, refit.collect()))

    assert bits(1) == bits(2)


def test_equal_spreads(spark):
    rng = np.random.default_rng(6)
    late = rng.integers(0, 41, (20, 32))  # every window of a track has the same beats, half an hour of them
    rows = [(k, i, 0.3 + i * 0.5 + int(late[k][i % 32]) / 1000.0) for k in range(20) for i in range(3600)]
    beats = spark.createDataFrame(rows, "track long, i long, t double")
    assert [r["start"] for r in T.fit_lattice(beats, "track").collect()] == [0] * 20


def test_odd_windows(spark):
    even = [0.3 + 0.5 * i for i in range(12)]
    tracks = [even, [*even[:5], None, *even[6:]], [*even[:5], float("nan"), *even[6:]], [*even[:5], float("inf"), *even[6:]], [0.3], [0.3, 0.3], [None, *even[1:]]]
    beats = spark.createDataFrame([(k, i, t) for k, own in enumerate(tracks) for i, t in enumerate(own)], "track long, i long, t double")
    got = {r["track"]: (r["period"], r["origin"], r["spread"]) for r in T.fit_windows(beats, "track").withColumn("drift", F.lit(0)).collect()}
    line = (pytest.approx(0.5), pytest.approx(0.3), pytest.approx(0, abs=1e-9))
    nan, none = (pytest.approx(float("nan"), nan_ok=True),) * 3, (None, None, None)
    assert got == {0: line, 1: line, 2: nan, 3: nan, 4: none, 5: none, 6: none}
