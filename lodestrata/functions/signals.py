"""Measurements of sampled signals: arrays in, structs out, batch by batch.

Defined results: a null or too short array gives null measurements; silence
gives no key and no tempo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of each degree of the scale in music of a major and a minor key, counted over a corpus (Albrecht and Shanahan).
MAJOR = np.array([0.238, 0.006, 0.111, 0.006, 0.137, 0.094, 0.016, 0.214, 0.009, 0.080, 0.008, 0.081])
MINOR = np.array([0.220, 0.006, 0.104, 0.123, 0.019, 0.103, 0.012, 0.214, 0.062, 0.022, 0.061, 0.052])
FRAME, HOP = 8192, 4096


def _frames(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    n = 1 + (len(x) - frame) // hop
    return np.lib.stride_tricks.sliding_window_view(x, frame)[:: hop][:n] if len(x) >= frame else np.empty((0, frame))


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Energy by pitch class between 55 and 2 000 Hz."""
    power = np.abs(np.fft.rfft(_frames(x, FRAME, HOP) * np.hanning(FRAME), axis=1)).sum(axis=0)
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hertz >= 55) & (hertz <= 2000)
    pitch = np.round(12 * np.log2(hertz[heard] / 440.0)).astype(int) + 9
    return np.bincount(pitch % 12, weights=power[heard], minlength=12)


def _profiles() -> np.ndarray:
    """The 24 keys, major then minor by tonic, each standardised, so that one product gives all correlations."""
    rows = np.array([np.roll(p, tonic) for p in (MAJOR, MINOR) for tonic in range(12)])
    rows = rows - rows.mean(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


_KEYS = _profiles()


def key_of(x: np.ndarray, rate: int) -> tuple[int, str, float, float, int, str] | None:
    """Tonic, mode, correlation and lead of the best of the 24 keys, and the tonic and mode of the next; none for less than two frames."""
    if len(x) < 2 * FRAME or not np.any(x):
        return None
    heard = chroma(x, rate)
    heard = heard - heard.mean()
    if not np.any(heard):
        return None
    scores = _KEYS @ (heard / np.linalg.norm(heard))
    best, second = np.argsort(-scores, kind="stable")[:2]
    name = lambda k: (int(k % 12), ("major", "minor")[k // 12])
    return (*name(best), float(scores[best]), float(scores[best] - scores[second]), *name(second))


def tempo_of(x: np.ndarray, rate: int, frame: int = 1024, hop: int = 256) -> tuple[float, float, float | None] | None:
    """Beats a minute between 60 and 200 from the autocorrelation of onsets weighed around 120, its strength against the strongest, and half or double of it where that is nearly as strong."""
    pieces = _frames(x, frame, hop)
    if len(pieces) < 32:
        return None
    flux = np.maximum(np.diff(np.abs(np.fft.rfft(pieces * np.hanning(frame), axis=1)), axis=0), 0).sum(axis=1)
    flux = flux - flux.mean()
    if not np.any(flux):
        return None
    n = 1 << (2 * len(flux) - 1).bit_length()
    spectrum = np.fft.rfft(flux, n)
    strength = np.fft.irfft(spectrum * spectrum.conj(), n)[: len(flux)]
    per_second = rate / hop
    lags = np.arange(max(1, int(per_second * 60 / 200)), min(len(strength) - 1, int(per_second * 60 / 60)) + 1)
    if len(lags) < 2 or strength[lags].max() <= 0:
        return None
    bpm, own = 60 * per_second / lags, strength[lags]
    at = int(np.argmax(own * np.exp(-0.5 * (np.log2(bpm / 120) / 0.9) ** 2)))
    twins = [int(np.argmin(np.abs(bpm - t))) for t in (bpm[at] / 2, bpm[at] * 2) if 60 <= t <= 200]
    twin = next((float(bpm[k]) for k in twins if own[at] > 0 and own[k] >= 0.8 * own[at]), None)
    return float(bpm[at]), float(own[at] / own.max()), twin


def measure_key(samples: Column | str, rate: int) -> Column:
    def run(series: pd.Series) -> pd.DataFrame:
        rows = [key_of(np.asarray(x, float), rate) if x is not None else None for x in series]
        return pd.DataFrame([r or (None,) * 6 for r in rows], columns=["tonic", "mode", "confidence", "lead", "next_tonic", "next_mode"])

    return F.pandas_udf(run, "struct<tonic:int,mode:string,confidence:double,lead:double,next_tonic:int,next_mode:string>")(samples)


def measure_tempo(samples: Column | str, rate: int) -> Column:
    def run(series: pd.Series) -> pd.DataFrame:
        rows = [tempo_of(np.asarray(x, float), rate) if x is not None else None for x in series]
        return pd.DataFrame([r or (None,) * 3 for r in rows], columns=["bpm", "confidence", "twin_bpm"], dtype="float64")

    return F.pandas_udf(run, "struct<bpm:double,confidence:double,twin_bpm:double>")(samples)


def camelot(tonic: Column, mode: Column) -> Column:
    """The place of a key on the wheel of twelve: fifths stand next to each other, B major is 1B, its relative minor 1A."""
    number = F.when(mode == "major", F.pmod(tonic * 7 + F.lit(7), F.lit(12))).otherwise(F.pmod(tonic * 7 + F.lit(4), F.lit(12)))
    return F.concat((number + 1).cast("int").cast("string"), F.when(mode == "major", "B").otherwise("A"))


def robust_peak(values: Column) -> Column:
    """(greatest - median) / (1.4826 x median absolute deviation) of an array; null without spread."""
    def median(a: Column) -> Column:
        s = F.array_sort(a)
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    middle = median(values)
    spread = median(F.transform(values, lambda x: F.abs(x - middle)))
    return F.try_divide(F.array_max(values) - middle, F.nullif(spread * 1.4826, F.lit(0.0)))


def steepest_fall(levels: Column) -> Column:
    """Place (from 0) and size of the steepest fall between neighbours of an array of levels."""
    steps = F.zip_with(F.slice(levels, F.lit(1), F.size(levels) - 1), F.slice(levels, F.lit(2), F.size(levels) - 1), lambda a, b: a - b)
    most = F.array_max(steps)
    return F.when(F.size(levels) > 1, F.struct((F.array_position(steps, most) - 1).cast("int").alias("place"), most.alias("fall")))


def edge_of(x: np.ndarray, rate: int, frame: int = 16384, least_db: float = 30.0, width: float = 150.0) -> tuple[float, float] | None:
    """The frequency at which most frames fall off a cliff, and the share of frames that do within `width` of it.

    A frame's cliff is the largest drop of its smoothed spectrum over half a
    kilohertz above 8 kHz; frames with a smaller drop than `least_db` have none.
    """
    pieces = _frames(x, frame, frame)
    if not len(pieces) or not np.any(x):
        return None
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    level = 20 * np.log10(np.abs(np.fft.rfft(pieces * np.hanning(frame), axis=1)) + 1e-9)
    step = max(1, int(125 / hertz[1]))
    n = level.shape[1] // step
    bands = level[:, : n * step].reshape(len(level), n, step).mean(axis=2)
    centre = hertz[: n * step].reshape(n, step).mean(axis=1)
    heard = np.flatnonzero(centre >= 8000)
    if len(heard) < 6:
        return None
    fall = bands[:, heard[:-4]] - bands[:, heard[4:]]
    at, size = fall.argmax(axis=1), fall.max(axis=1)
    edges = centre[heard[at]][size >= least_db]
    if not len(edges):
        return 0.0, 0.0
    near = (np.abs(edges[:, None] - edges[None, :]) <= width).sum(axis=1) if len(edges) <= 2000 else np.array([(np.abs(edges - e) <= width).sum() for e in edges])
    best = int(near.argmax())
    return float(np.median(edges[np.abs(edges - edges[best]) <= width])), float(near[best]) / len(pieces)


def top_band_of(x: np.ndarray, rate: int, frame: int = 8192) -> float | None:
    """Level in dB of the highest tenth of the band against the band from 1 to 10 kHz."""
    pieces = _frames(x, frame, frame)
    if not len(pieces) or not np.any(x):
        return None
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    power = (np.abs(np.fft.rfft(pieces * np.hanning(frame), axis=1)) ** 2).mean(axis=0)
    reference = power[(hertz >= 1000) & (hertz <= 10000)]
    top = power[hertz >= 0.9 * rate / 2]
    if not len(reference) or not reference.mean() > 0:
        return None
    return float(10 * np.log10(max(top.mean(), 1e-30) / reference.mean()))


def measure_edge(samples: Column | str, rate: int) -> Column:
    def run(series: pd.Series) -> pd.DataFrame:
        rows = [edge_of(np.asarray(x, float), rate) if x is not None else None for x in series]
        return pd.DataFrame([r or (None, None) for r in rows], columns=["hertz", "share"], dtype="float64")

    return F.pandas_udf(run, "struct<hertz:double,share:double>")(samples)


def measure_top_band(samples: Column | str, rate: int) -> Column:
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([top_band_of(np.asarray(x, float), rate) if x is not None else None for x in series], dtype="float64")

    return F.pandas_udf(run, "double")(samples)
