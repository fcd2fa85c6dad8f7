"""Column expressions over beat grids: tempo, phase and bar arithmetic, names and keys.

Beats are ARRAY<STRUCT<n: bar position, tempo: BPM x 100, ms: time>>. All are built-in expressions inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How close a grid must be to its reference.
MAX_BPM_DELTA, MAX_PHASE_BEATS, CONFORMANCE_BPM = 0.5, 0.25, 0.05
#: Arbitration between two trackers.
COMPARE_BPM, ORIGIN_SLOP_MS, DOWNBEAT_SLOP_BEATS, RELABEL_AGREEMENT, DISPUTE_AGREEMENT = 0.05, 60.0, 0.5, 0.7, 0.6


def fold(t: Column, bar: Column) -> Column:
    """t moved by whole bars into (-bar/2, bar/2]."""
    return t - bar * F.ceil(t / bar - F.lit(0.5))


def phase(offset: Column, period: Column, bar: Column) -> tuple[Column, Column]:
    """(beats, whole bars) of an offset in seconds; zeros without a period or a bar."""
    beats = offset / period
    part = fold(beats, bar)
    usable = (period > 0) & (bar > 0)
    return F.when(usable, part).otherwise(F.lit(0.0)), F.when(usable, F.round((beats - part) / bar)).otherwise(F.lit(0.0))


def upper_median(values: Column) -> Column:
    """The element at size div 2 of the sorted array; null for an empty one."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.expr("1").cast("int") * F.floor(F.size(ordered) / 2).cast("int"))


def gaps(beats: Column) -> Column:
    """The positive steps between neighbouring beat times, in seconds."""
    times = F.transform(beats, lambda b: b["ms"])
    steps = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), times, lambda b, a: (b - a) / F.lit(1000.0))
    return F.filter(steps, lambda s: s > 0)


def laid_back_downbeat(first_ms: Column, first_n: Column, bpm: Column) -> Column:
    """The first downbeat of a grid that starts inside a bar: before its first beat by the missing beats."""
    back = F.round(first_ms - (first_n - 1) * F.lit(60000.0) / bpm)
    return F.when((first_n > 1) & (bpm > 0), back).otherwise(first_ms.cast("double"))


def failure_class(error: Column, same_meter: Column, bpm_delta: Column, ref_bpm: Column, bpm: Column, phase_beats: Column, bars: Column) -> Column:
    """The first fault of a failed score, in the order in which they are told."""
    ratio = F.when(ref_bpm > 0, bpm / ref_bpm).otherwise(F.lit(0.0))
    off, whole = F.abs(phase_beats), F.round(F.abs(phase_beats))

    def near(x: float, slop: float) -> Column:
        return F.abs(ratio - x) < slop

    tempo = (
        F.when(near(2.0, 0.02), "tempo: double")
        .when(near(0.5, 0.005), "tempo: half")
        .when(near(1.5, 0.02) | near(2.0 / 3, 0.01), "tempo: 3:2")
        .when(F.abs(bpm_delta) <= 2, "tempo: near (within 2 BPM)")
        .otherwise("tempo: other")
    )
    on_beat = F.abs(off - whole) <= MAX_PHASE_BEATS
    within = (
        F.when(on_beat & (whole == 2), "phase: half a bar")
        .when(on_beat, F.concat(F.lit("phase: "), whole.cast("int").cast("string"), F.lit(" beat(s)")))
        .when(F.abs(off - 0.5) <= 0.1, "phase: half a beat")
        .otherwise("phase: fraction")
    )
    return (
        F.when(error, "error")
        .when(~same_meter, "meter")
        .when(F.abs(bpm_delta) > MAX_BPM_DELTA, tempo)
        .when(off > MAX_PHASE_BEATS, within)
        .when(bars != 0, "bars: whole bars off")
        .otherwise("other")
    )


def normal_name(path: Column) -> Column:
    """A file's base name without extension, lower case, letters a-z and digits only."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(base), "[^a-z0-9]", "")


def shift(beats: Column, ms: Column) -> Column:
    """Every beat moved by ms, none before zero."""
    return F.transform(beats, lambda b: b.withField("ms", F.greatest(b["ms"] + ms, F.lit(0).cast("long"))))


def relabel(n: Column, place: Column, by: Column, bar: Column) -> Column:
    """A beat number rotated by some beats; number 0 is told from its place."""
    return F.when(n == 0, F.pmod(place - by, bar) + 1).otherwise(F.pmod(n - 1 - by, bar) + 1)


#: Tonics round the circle of fifths; the place gives the Camelot number.
_MAJOR = ["B", "F#", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E"]
_MINOR = ["Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "Db"]
_ALIKE = {"C#": "Db", "D#": "Eb", "Gb": "F#", "G#": "Ab", "A#": "Bb"}


def camelot_table() -> dict[str, str]:
    """Key names in lower case to Camelot names, with enharmonic spellings."""
    out = {}
    for mode, letter, tonics in (("major", "B", _MAJOR), ("minor", "A", _MINOR)):
        for i, tonic in enumerate(tonics):
            for name in [tonic, *[a for a, b in _ALIKE.items() if b == tonic]]:
                out[f"{name} {mode}".lower()] = f"{i + 1}{letter}"
    return out


def camelot(key: Column) -> Column:
    """"D minor" to "7A"; '' for anything else."""
    pairs = F.create_map(*[F.lit(x) for item in camelot_table().items() for x in item])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(key))), F.lit(""))
