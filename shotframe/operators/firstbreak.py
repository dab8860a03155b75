"""Assisted first breaks: picks that follow a few seeds over each gather.

Traces are conditioned one by one (gain control), a gather's seeds make a guide that is linear between them, each trace is picked within a
window round its guide, moved by its correlation with the nearest seed's wavelet and snapped to a phase; picks far from the gather's
trend are tried once more round the trend. Everything per trace runs on rows; of a gather only its seeds (set by hand, so few), one
wavelet and medians are gathered, and go back to its traces by a join on the gather.

Tables: traces (gather, trace, offset, samples), seeds (gather, trace, ms). Times are milliseconds; a null pick is no pick.

Defined results: a trace without samples or with next to none of its gather's level is dead, and has no pick unless it is a seed; a gather
with fewer than two seeds of different places has its seeds alone; offsets order a gather if more than half of its traces have one, else the
traces' numbers do, and a missing offset counts as the trace's number; seeds of one place are averaged in order; seeds of traces that aren't
there and null seeds are left out; several seeds of one trace: the guide takes all, the trace the last by time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, traces

SIGMA = 1.4826


@dataclass(frozen=True)
class Options:
    sta_ms: float = 8.0
    lta_ms: float = 60.0
    threshold: float = 2.5
    window_ms: float = 25.0
    phase: str = "peak"
    gain_ms: float = 200.0
    wavelet_ms: float = 30.0
    outlier: float = 4.0
    dead_share: float = 0.02


def _near(x: float) -> int:
    return math.floor(x + 0.5)


def conditioned(x: np.ndarray, gain_ms: float, interval_us: float) -> np.ndarray:
    """x over the rms of its neighbours within half the gain's window."""
    level = traces.neighbour_levels(x, max(1, _near(gain_ms * 500 / interval_us)), "rms")
    return np.where(level > 1e-10, x / np.where(level > 1e-10, level, 1.0), 0.0)


def around(x: np.ndarray, centre: float, half: int) -> np.ndarray:
    """2 * half + 1 samples round a place, zeros where the trace ends."""
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
    at = _near(centre)
    out = np.zeros(2 * half + 1)
    lo, hi = max(0, at), min(len(padded), at + 2 * half + 1)
    if lo < hi:
        out[lo - at : hi - at] = padded[lo:hi]
    return out


def guide(places: np.ndarray, times: np.ndarray, key: float) -> float:
    """The line through the seeds at a place, the outer ones carried on."""
    k = min(max(int(np.searchsorted(places, key, side="left")), 1), len(places) - 1)
    return float(times[k] + (times[k] - times[k - 1]) / (places[k] - places[k - 1]) * (key - places[k])) if key > places[0] else float(times[0] + (times[1] - times[0]) / (places[1] - places[0]) * (key - places[0]))


def snapped(x: np.ndarray, ms: float, interval_us: float, phase: str, reach: int) -> float:
    """The nearest peak, trough or zero crossing within reach samples, between samples; ms where there is none."""
    centre = _near(ms * 1000 / interval_us)
    if len(x) < 3 or not 0 <= centre < len(x):
        return ms
    lo, hi = max(1, centre - reach), min(len(x) - 2, centre + reach)
    if lo > hi:
        return ms
    i = np.arange(lo, hi + 1)
    if phase == "zero":
        a, b = x[i], x[i + 1]
        turns = i[(a != b) & (a * b <= 0)]
        if not len(turns):
            return ms
        at = turns[np.argmin(np.abs(turns - centre))]
        place = at + min(1.0, max(0.0, -x[at] / (x[at + 1] - x[at])))
    else:
        sign = -1.0 if phase == "trough" else 1.0
        at = int(i[np.argmax(sign * x[i])])
        before, here, after = sign * x[at - 1], sign * x[at], sign * x[at + 1]
        bend = before - 2 * here + after
        step = 0.5 * (before - after) / bend if bend else 0.0
        place = at + (step if abs(step) <= 1 else 0.0)
    return place * interval_us / 1000


def pick(x: np.ndarray, low: float, high: float, wavelet: np.ndarray | None, interval_us: float, o: Options) -> tuple[float | None, float]:
    """The pick of a conditioned trace between two times, and how well it matches the wavelet."""
    per_ms = 1000 / interval_us
    sta = max(1, _near(o.sta_ms * per_ms))
    end = min(len(x), math.ceil(high * per_ms)) if high > 0 else len(x)
    found = traces.first_pick(x, sta, max(sta + 1, _near(o.lta_ms * per_ms)), o.threshold, max(sta + 4, math.floor(low * per_ms) if low > 0 else 0), end)
    if found is None:
        return None, 0.0
    ms, match, half = found / per_ms, 0.0, max(2, _near(o.wavelet_ms * per_ms))
    if wavelet is not None:
        lag, coefficient = kernels.correlate(around(x, ms * per_ms, half), wavelet)
        ms, match = min(high, max(low, ms + lag / per_ms)), min(1.0, abs(coefficient))
    return min(high, max(low, snapped(x, ms, interval_us, o.phase, max(2, min(40, _near(half / 2)))))), match


def _conditioned_column(o: Options, interval_us: float):
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else conditioned(np.nan_to_num(np.asarray(x, float), posinf=0.0, neginf=0.0), o.gain_ms, interval_us) for x in xs], dtype=object)

    return F.pandas_udf(run, "array<double>")


def _picks_column(o: Options, interval_us: float):
    def run(xs: pd.Series, low: pd.Series, high: pd.Series, wavelets: pd.Series) -> pd.DataFrame:
        found = [pick(np.asarray(x, float), lo, hi, None if w is None else np.asarray(w, float), interval_us, o) for x, lo, hi, w in zip(xs, low, high, wavelets, strict=True)]
        return pd.DataFrame({"ms": [np.nan if ms is None else ms for ms, _ in found], "match": [m for _, m in found]})

    return F.pandas_udf(run, "ms double, match double")


def _only(wanted: Column) -> Column:
    """The conditioned samples of the wanted traces, none of the others: a Python column is evaluated for every row."""
    return F.when(wanted, F.col("x")).otherwise(F.array().cast("array<double>"))


def guided(rows: DataFrame, seeds: DataFrame, o: Options, interval_us: float) -> DataFrame:
    """rows with key, rms, dead, seed (ms), guide (ms, null without two seeds) and the gather's wavelet."""
    finite = F.filter(F.coalesce(F.col("samples"), F.array().cast("array<double>")), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    power = F.aggregate(F.transform(finite, lambda v: v.cast("double") * v), F.lit(0.0), lambda a, b: a + b)
    base = rows.withColumn("rms", F.when(F.size(finite) > 0, F.sqrt(power / F.size(finite))).otherwise(0.0)).withColumn("x", _conditioned_column(o, interval_us)("samples"))
    known = F.col("offset").isNotNull() & ~F.isnan(F.col("offset").cast("double"))
    gathers = base.groupBy("gather").agg(F.percentile(F.when(F.col("rms") > 0, F.col("rms")), 0.5).alias("level"), (F.count_if(known) > 0.5 * F.count("*")).alias("by_offset"))
    keyed = base.join(gathers, "gather").withColumn("key", F.when(F.col("by_offset") & known, F.abs(F.col("offset").cast("double"))).otherwise(F.col("trace").cast("double")))
    keyed = keyed.withColumn("dead", (F.col("rms") <= 0) | F.col("x").isNull() | F.coalesce(F.col("rms") < o.dead_share * F.col("level"), F.lit(False)))
    good = seeds.where("ms IS NOT NULL AND NOT isnan(ms)").select("gather", "trace", F.col("ms").cast("double").alias("seed"))
    placed = keyed.select("gather", "trace", "key", "x").join(good, ["gather", "trace"])
    half = max(2, _near(o.wavelet_ms * 1000 / interval_us))

    def wavelets(xs: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else around(np.asarray(x, float), t * 1000 / interval_us, half) for x, t in zip(xs, ms, strict=True)], dtype=object)

    # A gather's seeds: a handful set by hand; of their samples only the first one's wavelet.
    picked = placed.withColumn("wavelet", F.pandas_udf(wavelets, "array<double>")("x", "seed"))
    line = picked.groupBy("gather").agg(F.sort_array(F.collect_list(F.struct("key", "trace", "seed"))).alias("seeds"), F.min_by("wavelet", F.when(F.col("wavelet").isNotNull(), F.struct("key", "trace", "seed"))).alias("wavelet"))

    def guides(keys: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for key, found in zip(keys, lists, strict=True):
            places: list[float] = []
            times: list[float] = []
            for s in found if found is not None else ():
                if places and abs(s["key"] - places[-1]) < 1e-9:
                    times[-1] = (times[-1] + s["seed"]) / 2
                else:
                    places.append(s["key"])
                    times.append(s["seed"])
            out.append(guide(np.array(places), np.array(times), key) if len(places) > 1 else np.nan)
        return pd.Series(out)

    own = good.groupBy("gather", "trace").agg(F.max("seed").alias("seed"))
    joined = keyed.join(line, "gather", "left").join(own, ["gather", "trace"], "left").withColumn("guide", F.nanvl(F.pandas_udf(guides, "double")("key", "seeds"), F.lit(None).cast("double")))
    return joined.drop("seeds", "level", "by_offset")


def assist(rows: DataFrame, seeds: DataFrame, interval_us: float, options: Options | None = None) -> DataFrame:
    """(gather, trace, ms, source, confidence, deviation, dead, guide) of every trace that has a guide or a seed."""
    o = options or Options()
    base = guided(rows.select("gather", "trace", "offset", "samples"), seeds, o, interval_us).drop("samples")
    picks = _picks_column(o, interval_us)
    auto = F.col("seed").isNull() & ~F.col("dead") & F.col("guide").isNotNull()
    tried = base.withColumn("p", F.when(auto, picks(_only(auto), F.coalesce(F.col("guide") - o.window_ms, F.lit(0.0)), F.coalesce(F.col("guide") + o.window_ms, F.lit(0.0)), "wavelet")))
    tried = tried.withColumn("auto", F.nanvl("p.ms", F.lit(None).cast("double"))).withColumn("residual", F.col("auto") - F.col("guide"))
    trend = tried.groupBy("gather").agg(F.percentile("residual", 0.5).alias("trend"))
    spread = tried.join(trend, "gather").groupBy("gather").agg(F.first("trend").alias("trend"), F.percentile(F.abs(F.col("residual") - F.col("trend")), 0.5).alias("mad"))
    judged = tried.join(spread, "gather").withColumn("far", F.coalesce((F.col("mad") > 0) & (F.abs(F.col("residual") - F.col("trend")) > o.outlier * SIGMA * F.col("mad")), F.lit(False)))
    middle = F.coalesce(F.col("guide") + F.col("trend"), F.lit(0.0))
    again = judged.withColumn("q", F.when(F.col("far"), picks(_only(F.col("far")), middle - o.window_ms / 2, middle + o.window_ms / 2, "wavelet")))
    moved = F.nanvl("q.ms", F.lit(None).cast("double"))
    ms = F.coalesce(moved, F.col("auto"))
    match = F.when(moved.isNotNull() & F.col("wavelet").isNotNull(), F.col("q.match")).otherwise(F.col("p.match"))
    deviation = ms - F.col("guide") - F.col("trend")
    still = F.col("far") & (F.abs(deviation) > o.outlier * SIGMA * F.col("mad"))
    seeded = F.col("seed").isNotNull()
    return again.where(seeded | F.col("guide").isNotNull()).select(
        "gather", "trace", F.coalesce("seed", ms).alias("ms"), F.when(seeded, "seed").otherwise("auto").alias("source"),
        F.when(seeded, 1.0).when(F.col("auto").isNull(), 0.0).when(still, match * 0.5).otherwise(match).alias("confidence"),
        F.when(~seeded & F.col("auto").isNotNull() & (F.col("mad") > 0), deviation).otherwise(0.0).alias("deviation"), "dead", "guide")
