"""Provisional waveform frames from PCM that arrives in chunks: 150 columns a second, three bytes each.

Filters and the decaying peak follower depend on every sample before, so a track's chunks go through one state, in
order. The state is a few numbers and the last peaks, never the samples, so a track of any length takes the same memory.
``stream_frames`` keeps it in Structured Streaming's state store; ``batch_frames`` folds a finished table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a frame, corner frequencies of the bands, and look-back (ms) and decay of the followers.
COLUMNS = 150
CORNERS = ((("low", 300.0),), (("high", 250.0), ("low", 1200.0)), (("high", 3000.0), ("low", 9000.0)))
FOLLOWERS = ((300, 0.99), (200, 0.98), (100, 0.97))

SCHEMA = "track string, offset long, columns int, data binary"


def coefficients(kind: str, corner: float, rate: int) -> tuple[float, float, float, float, float]:
    """A second-order Butterworth section: b0, b1, b2, a1, a2."""
    w = 2.0 * math.pi * corner / rate
    alpha, cosine = math.sin(w) / math.sqrt(2.0), math.cos(w)
    gain, sign = (1.0 - cosine, 1.0) if kind == "low" else (1.0 + cosine, -1.0)
    return tuple(v / (1.0 + alpha) for v in (gain / 2, sign * gain, gain / 2, -2.0 * cosine, 1.0 - alpha))


#: Samples that are filtered as one block.
BLOCK = 256


@lru_cache(maxsize=64)
def _responses(a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the recursive half of a section gives in a block: to an impulse at each place (as a matrix), and to each of
    the two outputs before the block."""
    rows = []
    for y1, y2, x in ((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)):
        out = []
        for _ in range(BLOCK):
            y1, y2, x = x - a1 * y1 - a2 * y2, y1, 0.0
            out.append(y1)
        rows.append(np.array(out))
    back = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    return np.where(back >= 0, rows[0][np.maximum(back, 0)], 0.0), rows[1], rows[2]


def filtered(x: np.ndarray, c: tuple, state: list[float]) -> np.ndarray:
    """One section over some samples; ``state`` (two inputs, two outputs back) is carried on in place.

    Blocks are filtered as if silence went before, all at once; then each gets what the two outputs before it still give.
    """
    if not len(x):
        return np.zeros(0)
    b0, b1, b2, a1, a2 = c
    x1, x2, y1, y2 = state
    past = np.concatenate([[x2, x1], x])
    impulse, one, two = _responses(a1, a2)
    blocks = -(-len(x) // BLOCK)
    driven = np.zeros(blocks * BLOCK)
    driven[: len(x)] = b0 * x + b1 * past[1:-1] + b2 * past[:-2]
    out = driven.reshape(blocks, BLOCK) @ impulse.T
    ends = out[:, [-1, -2]].tolist()
    before = []
    p1, p2, q1, q2 = one[-1], two[-1], one[-2], two[-2]
    for e1, e2 in ends:
        before.append((y1, y2))
        y1, y2 = e1 + p1 * y1 + p2 * y2, e2 + q1 * y1 + q2 * y2
    before = np.array(before)
    out = (out + before[:, :1] * one + before[:, 1:] * two).reshape(-1)[: len(x)]
    last = np.concatenate([[state[3], state[2]], out])[-2:]
    state[:] = [float(past[-1]), float(past[-2]), float(last[1]), float(last[0])]
    return out


def bands() -> list[list[list[float]]]:
    """The state of each band's sections, at rest."""
    return [[[0.0] * 4 for _ in band] for band in CORNERS]


def magnitudes(x: np.ndarray, rate: int, sections: list[list[list[float]]]) -> np.ndarray:
    """(samples, bands): each band's magnitude on a scale of 32768."""
    out = np.empty((len(x), len(CORNERS)))
    for lane, (band, states) in enumerate(zip(CORNERS, sections)):
        y = x
        for (kind, corner), state in zip(band, states):
            y = filtered(y, coefficients(kind, corner, rate), state)
        out[:, lane] = np.abs(y) * 32768.0
    return out


def provisional(level: float) -> int:
    return int(min(1.0, level) * 127.0 + 0.5)


class Track:
    """One track's rendering state."""

    def __init__(self, rate: int):
        self.rate, self.count, self.first_ms, self.drawn = rate, 0, 0, 0
        self.sections = bands()
        self.peaks: list[list[float]] = []  # of each millisecond from first_ms on
        self.follow = [[0.0, 0] for _ in FOLLOWERS]
        self.pending: list[int] = []

    @classmethod
    def of(cls, text: str) -> Track:
        out = cls(1)
        out.__dict__.update(json.loads(text))
        return out

    def text(self) -> str:
        return json.dumps(self.__dict__)

    def push(self, samples: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(offset, columns, data) of the frames that these samples complete."""
        x = np.asarray(samples, np.float64) / 32768.0
        if len(x):
            levels = magnitudes(x, self.rate, self.sections)
            ms = (self.count + np.arange(len(x))) * 1000 // self.rate - self.first_ms
            starts = np.flatnonzero(np.concatenate([[True], ms[1:] != ms[:-1]]))
            peaks = np.zeros((max(int(ms[-1]) + 1, len(self.peaks)), 3))
            peaks[: len(self.peaks)] = np.array(self.peaks).reshape(-1, 3)
            peaks[ms[starts]] = np.maximum(peaks[ms[starts]], np.maximum.reduceat(levels, starts, axis=0))
            self.peaks = peaks.tolist()
            self.count += len(x)
        closed = self.count * 1000 // self.rate
        return self._draw(lambda column: (column + 1) * 1000 // COLUMNS < closed)

    def finish(self) -> list[tuple[int, int, bytes]]:
        """The rest, so that all frames add up to the detail width."""
        width = max(1, -(-self.count * COLUMNS // self.rate))
        whole = max(1, self.count * 1000 // self.rate) - self.first_ms  # the rest of the last millisecond does not count
        self.peaks = [[min(32767.0, v) for v in p] for p in self.peaks[:whole]]
        out = self._draw(lambda column: column < width)
        if self.pending:
            out.append(self._frame())
        return out

    def _draw(self, ready) -> list[tuple[int, int, bytes]]:
        out = []
        while ready(self.drawn):
            centre = min((self.drawn + 1) * 1000 // COLUMNS, self.first_ms + len(self.peaks) - 1)
            level = [self._followed(lane, centre) for lane in range(3)]
            shaped = 64.0 - 64.0 * math.cos(level[2] * math.pi / 32768.0)
            self.pending += [provisional(level[0] / 32768.0), provisional(level[1] / 32768.0), provisional(shaped / 128.0)]
            self.drawn += 1
            if len(self.pending) == 3 * COLUMNS:
                out.append(self._frame())
        keep = max(0, min(at for _, at in self.follow) - max(back for back, _ in FOLLOWERS) - self.first_ms)
        if keep:
            self.peaks, self.first_ms = self.peaks[keep:], self.first_ms + keep
        return out

    def _followed(self, lane: int, centre: int) -> float:
        back, decay = FOLLOWERS[lane]
        peak, at = self.follow[lane]
        start = max(0, centre - back)
        if not start <= at <= centre:
            peak, at = 0.0, start
        while at <= centre and at - self.first_ms < len(self.peaks):
            v = self.peaks[at - self.first_ms][lane]
            peak = max(v, v + decay * (peak - v))
            at += 1
        self.follow[lane] = [peak, at]
        return peak

    def _frame(self) -> tuple[int, int, bytes]:
        columns, data = len(self.pending) // 3, bytes(self.pending)
        self.pending = []
        return self.drawn - columns, columns, data


FIELDS = ["track", "offset", "columns", "data"]


def _rows(track: str, frames: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame([(track, *f) for f in frames], columns=FIELDS)


def batch_frames(chunks: DataFrame, rate: int) -> DataFrame:
    """Frames of (track, seq, samples) that lie there in whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, state = None, None
        for batch in batches:
            for name, samples in zip(batch["track"], batch["samples"]):
                if name != track:
                    if state is not None:
                        yield _rows(track, state.finish())
                    track, state = name, Track(rate)
                yield _rows(track, state.push(samples))
        if state is not None:
            yield _rows(track, state.finish())

    rows = chunks.select(F.col("track").cast("string").alias("track"), "seq", "samples")
    return rows.repartition("track").sortWithinPartitions("track", "seq").mapInPandas(run, SCHEMA)


def stream_frames(chunks: DataFrame, rate: int) -> DataFrame:
    """Frames of a stream of (track, seq, samples, last): chunks of a trigger go in order of seq, ``last`` ends a track."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        track = Track.of(state.get[0]) if state.exists else Track(rate)
        rows = pd.concat(list(batches)).sort_values("seq")
        frames = [f for x in rows["samples"] for f in track.push(x)]
        if rows["last"].any():
            frames += track.finish()
            state.remove()
        else:
            state.update((track.text(),))
        yield _rows(key[0], frames)

    return chunks.groupBy("track").applyInPandasWithState(run, SCHEMA, "state string", "append", "NoTimeout")
