"""The seven waves of a finished track: previews, details, colours and scales, from PCM chunks.

A track's chunks go in order through its filters, so the work is one pass of ``mapInPandas`` over rows sorted by track and
sequence. What is held of a track is its peak in each millisecond and the energy of each mono column, never its samples.
All arithmetic after that is on whole numpy columns; only the decaying followers step through milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.streaming.frames import FOLLOWERS, bands, magnitudes

#: Columns a second, of the mono preview and of the other previews.
RATE, MONO_WIDTH, WIDTH = 150, 400, 1200
#: Numerators of the lanes' preview factors, their range, shares held, weights of both neighbours.
NUMERATORS, FACTORS, HOLD = np.array([32768.0, 32768.0, 33376.0]), (0.8, 5.0), np.array([0.8, 0.85, 0.0])
BEFORE, AFTER = np.array([0.45, 0.35, 0.0]), np.array([0.05, 0.0, 0.0])
#: Weights of low, mid, high, 1 and the lanes' shares for red, green and blue of a colour detail.
DETAIL_WEIGHTS = np.array(
    [
        [0.0188281, 0.0289312, 0.0434023, 3.72048, 4.99576, -6.62306, -10.6358],
        [-0.0413379, 0.060421, 0.0513837, 4.86252, -2.29026, 1.16652, -6.63715],
        [-0.0208309, -0.00797648, 0.0217414, 6.66695, -3.11942, -1.51518, 16.3072],
    ]
)
#: Weights of low, mid, high and 1 for the six lanes of a colour preview, and each lane's largest value.
PREVIEW_WEIGHTS = np.array(
    [
        [0.451, 0.356, 0.495, 24.055],
        [-0.456, -0.386, -0.462, 228.221],
        [0.995, 0.174, -0.026, -3.113],
        [1.115, -0.029, -0.031, -7.992],
        [0.014, 0.587, -0.073, -2.593],
        [0.065, 0.014, 0.387, 6.843],
    ]
)
PREVIEW_MOST = np.array([127, 255, 127, 127, 127, 127])

SCHEMA = "track string, duration_ms long, kind string, entry_bytes int, entry_count int, rate int, source string, data binary"


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def as_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(np.trunc(x)), 0, 255).astype(np.uint8)


def bounds(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the items of each column; columns of fewer items than columns repeat them."""
    at = np.arange(width + 1) * n // width
    return at[:-1], np.minimum(n, np.maximum(at[1:], at[:-1] + 1))


def peaks(wave: np.ndarray, width: int) -> np.ndarray:
    """The largest value of each column and lane."""
    if not len(wave):
        return np.zeros((width, *wave.shape[1:]), wave.dtype)
    both = np.stack(bounds(len(wave), width), axis=1).ravel()
    return np.maximum.reduceat(np.concatenate([wave, wave[-1:]]), both, axis=0)[::2]


def preview_averages(source: np.ndarray) -> np.ndarray:
    """(WIDTH, 3): the mean of each column's milliseconds and those of a window before it, as if silence went before."""
    n, out = len(source), np.zeros((WIDTH, 3))
    columns = min(n, WIDTH)
    last = np.arange(1, columns + 1) if n <= WIDTH else -(-n * np.arange(1, WIDTH + 1) // WIDTH)
    first = np.concatenate([[0], last[:-1]])
    total = np.concatenate([np.zeros((1, 3)), np.cumsum(source, axis=0)])
    for lane, window in enumerate((n // 8000, n // 8000 * 2 // 3, n // 3000)):
        out[:columns, lane] = (total[last, lane] - total[np.maximum(0, first - window), lane]) / (last - first + window)
    return out


class Norm:
    """How the lanes of a preview are balanced, and its loudest balanced column."""

    def __init__(self, averages: np.ndarray):
        sums = averages.sum(axis=0)
        there = sums > 0
        self.balance = np.ones(3)
        if there.sum() >= 2:
            most, least = sums[there].max(), sums[there].min()
            self.balance[there] = 16384.0 * most / sums[there] if there.all() else 16384.0 * sums[there][::-1] / least
            if there[0] and there[1] and not there[2]:
                self.balance[2] = 16384.0 / least
        self.most = float((averages @ self.balance).max(initial=0.0))

    def factors(self) -> np.ndarray:
        return np.clip(self.balance * NUMERATORS / self.most, *FACTORS) / 256.0 if self.most > 0 else np.zeros(3)

    def caps(self) -> np.ndarray:
        return self.balance * 32768.0 / self.most if self.most > 0 else np.zeros(3)


def cosine(level: np.ndarray) -> np.ndarray:
    return 64.0 - 64.0 * np.cos(level * np.pi / 32768.0)


def scale_for(most: float, numerator: float, rounded) -> int:
    """The display scale of a lane, 1 to 500; 500 for silence."""
    return int(np.clip(rounded(numerator / most), 1, 500)) if most > 0 else 500


def linear_scale(most: float, cap: float, highest: float = 3.0) -> int:
    """The largest scale in hundredths that keeps a lane and its preview in range."""
    if most <= 0:
        return 0
    full = 32768.0 / most
    return int(max(0.8, min(highest, cap if 0 < cap < full else full)) * 100.0)


def capped(raw: int, cap: int, least: int = 5) -> int:
    """The cap, unless the raw scale is above it by less than ``least``."""
    return raw if 0 <= raw - cap < least else cap


def low_adjusted(raw: int, cap: int, preview: float) -> int:
    """Fixed adjustments of the low lane's cap, at most the raw scale."""
    return min(raw, cap + 2 if 94 <= cap <= 98 else 82 if cap == 80 and 0.77 <= preview < 0.82 else cap)


def band_scales(source: np.ndarray, norm: Norm) -> list[int]:
    low, mid = (float(source[:, k].max(initial=0.0)) for k in (0, 1))
    high = float(cosine(source[:, 2]).max(initial=0.0))
    raw = [scale_for(low, 127.0 * 25600.0, half_up), scale_for(mid, 128.0 * 25600.0, np.trunc), scale_for(high, 12700.0, np.ceil)]
    caps = norm.caps()
    limit = linear_scale(low, caps[0])
    first = capped(raw[0], limit)
    if first == limit < raw[0]:
        first = low_adjusted(raw[0], limit, caps[0])
    return [first, capped(raw[1], linear_scale(mid, caps[1])), raw[2]]


def preview(averages: np.ndarray, norm: Norm) -> np.ndarray:
    """The three-band preview: scaled averages that hold a share of the column before and blend with both neighbours."""
    own = as_bytes(averages * norm.factors()).astype(float)
    before = np.concatenate([own[:1], own[:-1]])
    before[0] = 0
    held = np.maximum(own, half_up(before * HOLD))
    left, right = np.concatenate([held[:1], held[:-1]]), np.concatenate([held[1:], held[-1:]])
    return as_bytes(half_up(held * (1.0 - BEFORE - AFTER) + left * BEFORE + right * AFTER))


def followed(values: np.ndarray, centres: np.ndarray, back: int, decay: float) -> np.ndarray:
    """The decaying peak at each centre: it follows all values up to there, from ``back`` before a centre on where it
    would otherwise stand still."""
    out, v, peak, at = np.empty(len(centres)), values.tolist(), 0.0, 0
    for i, centre in enumerate(centres.tolist()):
        start = max(0, centre - back)
        if not start <= at <= centre:
            peak, at = 0.0, start
        for x in v[at : centre + 1]:
            peak = x if x > peak else x + decay * (peak - x)
        at = max(at, centre + 1)
        out[i] = peak
    return out


def scroll(source: np.ndarray, width: int, scales: list[int]) -> np.ndarray:
    """The three-band detail."""
    if not len(source):
        return np.zeros((width, 3), np.uint8)
    centres = np.minimum(len(source) - 1, np.arange(1, width + 1) * len(source) // width)
    level = [followed(source[:, k], centres, *FOLLOWERS[k]) for k in range(3)]
    lanes = [level[0] * scales[0] / 25600.0, level[1] * scales[1] / 25600.0, cosine(level[2]) * scales[2] / 100.0]
    return np.stack([as_bytes(x) for x in lanes], axis=1)


def colour_preview(detail: np.ndarray) -> np.ndarray:
    """Six lanes of WIDTH columns."""
    wave = peaks(detail, WIDTH).astype(float)
    out = half_up(np.hstack([wave, np.ones((len(wave), 1))]) @ PREVIEW_WEIGHTS.T)
    return np.clip(out, 0, PREVIEW_MOST).astype(np.uint8)


def colour_detail(detail: np.ndarray, mono: np.ndarray, scales: list[int]) -> np.ndarray:
    """Three bits each of red, green and blue and five of the mono height, as big-endian pairs."""
    lanes = detail * (100.0 / np.array([s or 100 for s in scales]))
    total = lanes.sum(axis=1, keepdims=True) + 1.0
    red, green, blue = np.clip(half_up(np.hstack([lanes, np.ones_like(total), lanes / total]) @ DETAIL_WEIGHTS.T), 0, 7).astype(np.uint16).T
    height = np.zeros(len(detail), np.uint16)
    some = min(len(detail), len(mono))
    height[:some] = mono[:some] & 0x1F
    return (red << 13 | green << 10 | blue << 7 | height << 2).astype(">u2")


def packed_energy(energy: np.ndarray) -> np.ndarray:
    height = np.clip(half_up(energy * 31.0), 1, 31).astype(np.uint8)
    white = 4 + (height >= 24) + (height >= 30)
    return np.where(energy > 0, (white << 5 | height).astype(np.uint8), 0).astype(np.uint8)


def detail_width(samples: int, rate: int) -> int:
    return max(1, -(-samples * RATE // rate))


class Waves:
    """What is gathered of one track of ``total`` samples, and the waves drawn from it."""

    def __init__(self, rate: int, total: int):
        self.rate, self.total, self.count = rate, total, 0
        self.width = detail_width(total, rate)
        self.columns = max(self.width, MONO_WIDTH)
        self.first, self.last = bounds(total, self.columns)
        self.sections = bands()
        self.source = np.zeros((max(1, total * 1000 // rate), 3))
        self.energy = np.zeros(self.columns)

    def push(self, samples: np.ndarray) -> None:
        x = np.asarray(samples, np.float64) / 32768.0
        if not len(x):
            return
        level = magnitudes(x, self.rate, self.sections)
        at = self.count + np.arange(len(x))
        if self.rate >= 1000:
            ms = at * 1000 // self.rate
            starts = np.flatnonzero(np.concatenate([[True], ms[1:] != ms[:-1]]))
            own = np.maximum.reduceat(level, starts, axis=0)
            inside = ms[starts] < len(self.source)  # samples past the last whole millisecond do not count
            np.maximum.at(self.source, ms[starts][inside], own[inside])
        else:  # a sample fills several milliseconds
            every = np.arange(len(self.source))
            start = np.minimum(-(-every * self.rate // 1000), self.total - 1)
            end = np.minimum(np.maximum(-(-(every + 1) * self.rate // 1000), start + 1), self.total)
            for j, own in zip(at.tolist(), level):
                hit = (start <= j) & (j < end)
                self.source[hit] = np.maximum(self.source[hit], own)
        square = np.concatenate([[0.0], np.cumsum(x * x)])
        a, b = np.searchsorted(self.last, at[0], "right"), np.searchsorted(self.first, at[-1], "right")
        low, high = np.clip(self.first[a:b] - at[0], 0, len(x)), np.clip(self.last[a:b] - at[0], 0, len(x))
        self.energy[a:b] += square[high] - square[low]
        self.count += len(x)

    def waves(self) -> tuple[list[int], list[tuple]]:
        """(scales, rows): kind, bytes of an entry, entries, columns a second, file and data of the seven waves."""
        source = np.minimum(32767.0, self.source) if self.total else np.zeros((0, 3))
        mono = packed_energy(self.energy / np.maximum(1, self.last - self.first)) if self.total else np.zeros(self.columns, np.uint8)
        averages = preview_averages(source)
        norm = Norm(averages)
        scales = band_scales(source, norm)
        detail = scroll(source, self.width, scales)
        drawn = (
            ("mono_preview", 1, 0, "dat", peaks(mono, MONO_WIDTH)),
            ("mono_detail", 1, RATE, "ext", mono),
            ("color_preview", 6, 0, "ext", colour_preview(detail)),
            ("color_detail", 2, RATE, "ext", colour_detail(detail, mono, scales)),
            ("three_band_preview", 3, 0, "twoex", preview(averages, norm)),
            ("three_band_detail", 3, RATE, "twoex", detail),
            ("three_band_scales", 2, 0, "twoex", np.array(scales, ">u2")),
        )
        return scales, [(kind, size, len(data.tobytes()) // size, rate, source, data.tobytes()) for kind, size, rate, source, data in drawn]


def rendered(chunks: DataFrame, rate: int) -> DataFrame:
    """The seven waves of each track of (track, seq, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, own = None, None

        def done() -> pd.DataFrame:
            duration = int(half_up(np.float64(own.total / rate * 1000.0)))
            return pd.DataFrame([(track, duration, *w) for w in own.waves()[1]], columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for name, total, samples in zip(batch["track"], batch["total"], batch["samples"]):
                if name != track:
                    if own is not None:
                        yield done()
                    track, own = name, Waves(rate, int(total))
                own.push(samples)
        if own is not None:
            yield done()

    total = F.sum(F.size("samples")).over(Window.partitionBy("track"))
    rows = chunks.select(F.col("track").cast("string").alias("track"), "seq", "samples").withColumn("total", total)
    return rows.sortWithinPartitions("track", "seq").mapInPandas(run, SCHEMA)
