"""Array kernels that need numpy (Fourier transforms, correlation): Arrow-batched over rows, no shuffle of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x) -> np.ndarray:
    return np.nan_to_num(np.asarray([] if x is None else x, dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)


def _power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def spectrum_of(x: np.ndarray) -> np.ndarray:
    """Hann-tapered amplitudes without the Nyquist bin; 2 |X| / sum of the taper, the constant once."""
    if not len(x):
        return np.empty(0)
    w, size = hann(len(x)), _power_of_two(len(x))
    out = 2 * np.abs(np.fft.rfft(x * w, size))[: max(1, size // 2)] / w.sum()
    out[0] /= 2
    return out


def amplitude_spectrum(samples: Column) -> Column:
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([spectrum_of(_finite(x)) for x in xs])

    return F.pandas_udf(run, "array<double>")(samples)


def average_spectrum(traces: DataFrame, samples_col: str, *groups: str) -> DataFrame:
    """(groups, bin, amplitude): mean amplitude by bin, of traces of one length."""
    rows = traces.select(*groups, F.posexplode(amplitude_spectrum(F.col(samples_col))).alias("bin", "a"))
    return rows.groupBy(*groups, "bin").agg(F.avg("a").alias("amplitude"))


def correlate(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Lag (samples by which a comes after b) of the largest normalised correlation in magnitude, the first of equals, and the coefficient."""
    n = len(a) + len(b) - 1
    if not len(a) or not len(b):
        return 0, 0.0
    size = _power_of_two(n)
    whole = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    lags = np.arange(-(len(b) - 1), len(a))
    values = whole[lags % size]
    energy = np.sqrt((a * a).sum() * (b * b).sum())
    values = values / energy if energy > 0 else np.zeros(n)
    at = int(np.argmax(np.round(np.abs(values), 9)))
    return int(lags[at]), float(values[at])


def cross_correlation(a: Column, b: Column) -> Column:
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([correlate(_finite(x), _finite(y)) for x, y in zip(xs, ys, strict=True)], columns=["lag", "coefficient"])

    return F.pandas_udf(run, "lag int, coefficient double")(a, b)


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    spectrum = np.fft.fft(x)
    spectrum[1 : (n + 1) // 2] *= 2
    spectrum[n // 2 + 1 :] = 0
    return np.fft.ifft(spectrum)


def envelope(samples: Column) -> Column:
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([np.abs(analytic(_finite(x))) if x is not None and len(x) else np.empty(0) for x in xs])

    return F.pandas_udf(run, "array<double>")(samples)


def instantaneous_phase(samples: Column) -> Column:
    """Unwrapped; a jump of just pi is left."""

    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            phase = np.angle(analytic(_finite(x))) if x is not None and len(x) else np.empty(0)
            jump = np.diff(phase)
            turn = np.where(jump > np.pi, -2 * np.pi, np.where(jump < -np.pi, 2 * np.pi, 0))
            out.append(phase + np.append(0, np.cumsum(turn)) if len(phase) else phase)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(samples)


def spectrogram(samples: Column, window: int = 128, hop: int = 64) -> Column:
    """Frames of unscaled Hann-tapered magnitudes; a trace shorter than the window is one padded frame."""

    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            v, taper = _finite(x), hann(window)
            frames = max(1, (len(v) - window) // hop + 1)
            padded = np.append(v, np.zeros(window))
            out.append([np.abs(np.fft.rfft(padded[i * hop : i * hop + window] * taper))[: window // 2].tolist() for i in range(frames)])
        return pd.Series(out)

    return F.pandas_udf(run, "array<array<double>>")(samples)


def fk_spectrum(gathers: DataFrame, gather_col: str, order_col: str, samples_col: str, samples_kind: str = "long") -> DataFrame:
    """(gather, kx, f, amplitude) of each whole gather; a gather is the unit of the transform and must fit a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        x = np.stack([_finite(v) for v in rows["x"]])
        nx, nt = _power_of_two(x.shape[0]), _power_of_two(x.shape[1])
        half = nt // 2
        spectrum = np.abs(np.fft.fftshift(np.fft.fft(np.fft.rfft(x, nt, axis=1)[:, :half], nx, axis=0), axes=0))
        k, f = np.meshgrid(np.arange(nx) - nx // 2, np.arange(half), indexing="ij")
        return pd.DataFrame({"g": rows["g"].iloc[0], "kx": k.ravel(), "f": f.ravel(), "amplitude": spectrum.ravel()})

    rows = gathers.select(F.col(gather_col).cast(samples_kind).alias("g"), F.col(order_col).alias("o"), F.col(samples_col).alias("x"))
    return rows.groupBy("g").applyInPandas(run, f"g {samples_kind}, kx int, f int, amplitude double").withColumnRenamed("g", gather_col)
