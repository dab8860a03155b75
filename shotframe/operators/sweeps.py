"""Vibrator sweeps: designs of several kinds with tapers, their correlation wavelets, and the harmonic distortion of recorded ones.

A design is a row of parameters (sweep, kind, f0, f1, ms, slope, taper_in_ms, taper_out_ms, taper, phase_deg, amplitude); its samples are
made by whole-array kernels where the row is. Kinds: linear; dbhz and dboct (dwell grows by slope dB a hertz or an octave); tpower (the
rate of frequency grows with time to the power slope). Tapers: cosine or blackman. Phases are summed by trapezoids of the designed frequency.

Defined results: a design with faults has no samples but tells its faults; nulls take defaults (linear, no taper, phase 0, amplitude 1);
a trace without samples has a wavelet without side lobes and no distortion; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

# Limits of designs.
LOWEST, HIGHEST, LONGEST_MS = 0.1, 999.9, 65_535
SLOPES = {"linear": 0.0, "dbhz": 0.1, "dboct": 3.0, "tpower": 2.0}
SLOPE_LIMITS = {"dbhz": (-10, 10), "dboct": (-24, 24), "tpower": (0, 10)}


def faults(c: dict[str, Column], rate_hz: float) -> Column:
    """What is wrong with a design, array<string>; empty for a sound one."""
    known = F.array(*[F.lit(k) for k in SLOPES])
    said = [
        F.when(~F.array_contains(known, c["kind"]), "kind"),
        *[F.when(c[f].isNull() | ~c[f].between(LOWEST, HIGHEST), f) for f in ("f0", "f1")],
        F.when(c["ms"].isNull() | ~c["ms"].between(1, LONGEST_MS), "length"),
        F.when((c["taper_in_ms"] < 0) | (c["taper_out_ms"] < 0) | (c["taper_in_ms"] + c["taper_out_ms"] > c["ms"]), "taper"),
        F.when((c["amplitude"] <= 0) | (c["amplitude"] > 1), "amplitude"),
        F.when(F.greatest(c["f0"], c["f1"]) > rate_hz / 2, "nyquist"),
        *[F.when((c["kind"] == k) & ~c["slope"].between(*limits), "slope") for k, limits in SLOPE_LIMITS.items()]]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def frequency(kind: str, f0: float, f1: float, x: np.ndarray, slope: float) -> np.ndarray:
    """The frequency at shares x of a sweep's length."""
    x = np.clip(x, 0.0, 1.0)
    if kind == "dbhz" and abs(beta := slope * np.log(10) / 10) > 1e-12 and f0 != f1:
        return f0 + np.log1p(x * np.expm1(beta * (f1 - f0))) / beta
    if kind == "dboct" and abs(slope) > 1e-12 and f0 != f1:
        q = slope * np.log2(10) / 10 + 1
        return f0 * (f1 / f0) ** x if abs(q) < 1e-9 else (f0**q + x * (f1**q - f0**q)) ** (1 / q)
    return f0 + (f1 - f0) * (x ** (max(0.0, slope) + 1) if kind == "tpower" else x)


def ramp(x: np.ndarray, taper: str) -> np.ndarray:
    c = np.clip(x, 0.0, 1.0)
    return 0.42 - 0.5 * np.cos(np.pi * c) + 0.08 * np.cos(2 * np.pi * c) if taper == "blackman" else 0.5 - 0.5 * np.cos(np.pi * c)


def design(kind: str, f0: float, f1: float, ms: float, slope: float, into: float, out: float, taper: str, phase_deg: float, amplitude: float, rate_hz: float) -> dict[str, np.ndarray]:
    n = int(np.floor(ms / 1000 * rate_hz + 0.5)) + 1
    t = np.arange(n) * (1000 / rate_hz)
    f = frequency(kind, f0, f1, t / ms, slope)
    level = np.full(n, amplitude)
    if into > 0:
        level = np.where(t < into, level * ramp(t / into, taper), level)
    if out > 0:
        level = np.where(t > ms - out, level * ramp((ms - t) / out, taper), level)
    level = np.maximum(level, 0.0)
    phase = np.radians(phase_deg) + np.concatenate([[0.0], np.cumsum(np.pi * (f[1:] + f[:-1]) / rate_hz)])
    return {"frequency": f, "envelope": level, "phase_deg": np.degrees(phase), "samples": level * np.cos(phase)}


def designs(specs: DataFrame, rate_hz: float) -> DataFrame:
    """specs with faults, and the arrays frequency, envelope, phase_deg (unwrapped) and samples of the sound ones."""
    defaults = {"kind": "linear", "taper_in_ms": 0.0, "taper_out_ms": 0.0, "taper": "cosine", "phase_deg": 0.0, "amplitude": 1.0}
    c = {k: F.coalesce(F.col(k), F.lit(v)) if k in specs.columns else F.lit(v) for k, v in defaults.items()}
    c |= {k: F.col(k).cast("double") for k in ("f0", "f1", "ms")}
    own = F.coalesce(*[F.when(c["kind"] == k, F.lit(v)) for k, v in SLOPES.items()])
    c["slope"] = F.coalesce(F.col("slope").cast("double"), own) if "slope" in specs.columns else own

    def run(kind, f0, f1, ms, slope, into, out, taper, phase, amplitude, wrong) -> pd.DataFrame:
        made = [design(k, a, b, m, s, i, o, t, p, v, rate_hz) if not w else {} for k, a, b, m, s, i, o, t, p, v, w in zip(kind, f0, f1, ms, slope, into, out, taper, phase, amplitude, wrong, strict=True)]
        return pd.DataFrame({k: pd.Series([x.get(k) for x in made], dtype=object) for k in ("frequency", "envelope", "phase_deg", "samples")})

    names = ("kind", "f0", "f1", "ms", "slope", "taper_in_ms", "taper_out_ms", "taper", "phase_deg", "amplitude")
    made = F.pandas_udf(_typed(run), "frequency array<double>, envelope array<double>, phase_deg array<double>, samples array<double>")
    rows = specs.withColumn("faults", faults(c, rate_hz))
    return rows.withColumn("made", made(*[c[n] for n in names], F.size("faults") > 0)).select(*specs.columns, "faults", F.col("made.frequency").alias("frequency"), F.col("made.envelope").alias("envelope"), F.col("made.phase_deg").alias("designed_phase"), F.col("made.samples").alias("samples"))


def _typed(run):
    """run with the hints that tell Spark its columns are series."""

    def typed(
        kind: pd.Series, f0: pd.Series, f1: pd.Series, ms: pd.Series, slope: pd.Series, into: pd.Series, out: pd.Series, taper: pd.Series, phase: pd.Series, amplitude: pd.Series, wrong: pd.Series) -> pd.DataFrame:
        return run(kind, f0, f1, ms, slope, into, out, taper, phase, amplitude, wrong)

    return typed


def klauder_of(x: np.ndarray, interval_us: float, half_ms: float = 250.0) -> tuple[float, float]:
    """(side lobe, main lobe) of a sweep's autocorrelation within half_ms: decibels of the peak over the largest lobe beyond the first change of
    sign (120 at most), and milliseconds between the changes of sign on either side (0 if there is none)."""
    n = len(x)
    if not n:
        return 0.0, 0.0
    size = 1 << (2 * n - 1).bit_length()
    whole = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)
    half = max(2, min(n - 1, int(np.floor(half_ms * 1000 / interval_us + 0.5))))
    w = whole[: half + 1] / (abs(whole[0]) or 1.0)
    turns = np.flatnonzero((w[1:] > 0) != (w[:-1] > 0)) + 1
    if not len(turns):
        return 120.0, 0.0
    side = np.abs(w[turns[0] :]).max()
    return min(120.0, float(-20 * np.log10(side))) if side > 0 else 120.0, float(2 * turns[0] * interval_us / 1000)


def klauder(samples: Column, interval_us: float, half_ms: float = 250.0) -> Column:
    """struct<sidelobe_db, main_lobe_ms>"""

    def run(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([klauder_of(kernels._finite(x), interval_us, half_ms) for x in xs], columns=["sidelobe_db", "main_lobe_ms"])

    return F.pandas_udf(run, "sidelobe_db double, main_lobe_ms double")(samples)


def distortion_of(x: np.ndarray, f: np.ndarray, interval_us: float, window_ms: float = 250.0, harmonics: int = 5) -> list[tuple[float, float]]:
    """(ms, percent) of harmonics 2 to ``harmonics`` over the fundamental, at some 48 places of a recorded sweep with designed frequencies f.

    A window holds four cycles at least; a line is the largest amplitude in a band as wide as the sweep moves within the window."""
    n, rate = min(len(x), len(f)), 1e6 / interval_us
    out = []
    if n < 8:
        return out
    for c in range(0, n, max(1, int(np.floor((n - 1) / 48 + 0.5)))):
        fc = f[c]
        half = int(np.floor(max(window_ms / 1000, 4 / fc) * rate / 2 + 0.5)) if fc > 0.5 else n
        if fc <= 0.5 or 2 * fc >= 0.475 * rate or c - half < 0 or c + half >= n:
            continue
        m = 2 * half + 1
        size = 1 << (2 * m - 1).bit_length()
        lines, bin_hz = np.abs(np.fft.rfft(x[c - half : c + half + 1] * kernels.hann(m), size)), rate / size
        moved = abs(f[c + half] - f[c - half])

        def line(h: int, lines=lines, bin_hz=bin_hz, moved=moved, fc=fc, size=size) -> float:
            band = min(h * moved / 2 + max(2 * bin_hz, 0.05 * fc), 0.4 * fc)
            lo, hi = max(1, int((h * fc - band) // bin_hz)), min(size // 2 - 1, int(np.ceil((h * fc + band) / bin_hz)))
            return float(lines[lo : hi + 1].max()) if lo <= hi else 0.0

        first = line(1)
        if first > 0:
            above = sum(line(h) ** 2 for h in range(2, max(2, harmonics) + 1) if h * fc < rate / 2)
            out.append((c * interval_us / 1000, 100 * above**0.5 / first))
    return out


def distortion(samples: Column, frequencies: Column, interval_us: float, window_ms: float = 250.0, harmonics: int = 5) -> Column:
    """struct<average, most, series: array<struct<ms, percent>>> of recorded sweeps."""

    def run(xs: pd.Series, fs: pd.Series) -> pd.DataFrame:
        found = [distortion_of(kernels._finite(x), kernels._finite(f), interval_us, window_ms, harmonics) for x, f in zip(xs, fs, strict=True)]
        values = [[p for _, p in s] for s in found]
        return pd.DataFrame({"average": [float(np.mean(v)) if v else 0.0 for v in values], "most": [max(v, default=0.0) for v in values], "series": [[{"ms": a, "percent": b} for a, b in s] for s in found]})

    return F.pandas_udf(run, "average double, most double, series array<struct<ms: double, percent: double>>")(samples, frequencies)
