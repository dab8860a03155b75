"""Per-trace operators: native higher-order functions over (trace id, samples) rows, or numpy over a trace at a time. Only
``semblance`` (by gather), ``neighbour_scores`` (by record) and ``difference`` (a join) shuffle.

Samples that are null or not finite count as 0 in sums but keep their place, unless an operator says otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .survey import local_median


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def as_doubles(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.when(finite(x.cast("double")), x.cast("double")).otherwise(0.0))


def js_round(x: Column) -> Column:
    """Halves go up, whatever the sign."""
    return F.floor(x + 0.5)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body's own lambdas use it for every sample."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def rms(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / F.size(xs))).otherwise(0.0)


def peak(xs: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(xs, F.abs)), F.lit(0.0))


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(0.0)


def population_std(xs: Column) -> Column:
    """Two passes: the mean, then the mean square about it."""
    square = bound(mean(xs), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(F.size(xs) > 0, F.sqrt(square / F.size(xs))).otherwise(0.0)


def zero_crossings(xs: Column) -> Column:
    """Sign changes between neighbouring non-zero samples."""
    signs = F.filter(F.transform(xs, F.signum), lambda s: s != 0)
    return F.aggregate(
        signs, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("last")),
        lambda a, s: F.struct((a["n"] + F.when((a["last"] != 0) & (a["last"] != s), 1).otherwise(0)).alias("n"), s.alias("last")),
        lambda a: a["n"])


def longest_run(xs: Column, level: Column) -> Column:
    """The most neighbouring samples whose magnitude reaches level."""
    return F.aggregate(
        xs, F.struct(F.lit(0).alias("best"), F.lit(0).alias("now")),
        lambda a, x: F.struct(F.greatest(a["best"], F.when(F.abs(x) >= level, a["now"] + 1).otherwise(0)).alias("best"), F.when(F.abs(x) >= level, a["now"] + 1).otherwise(0).alias("now")),
        lambda a: a["best"])


def norm_percentile(xs: Column, p: float = 0.95) -> Column:
    """The magnitude at index floor(p (n - 1)); 1 if it is next to nothing."""
    ranked = F.sort_array(F.transform(xs, F.abs))
    at = F.floor(F.lit(p) * (F.size(xs) - 1)).cast("int") + 1
    found = F.when(F.size(xs) > 0, F.element_at(ranked, F.greatest(at, F.lit(1))))
    return F.when(found > 1e-12, found).otherwise(1.0)


def evidence(traces: DataFrame, id_col: str, samples_col: str, *kept: str, rail: float = 0.985) -> DataFrame:
    """rms, peak, standard deviation, zero crossings and their rate, longest run at the rail, percentile norm; with the columns kept."""
    x = F.col("__x")
    base = traces.select(F.col(id_col), *kept, as_doubles(F.col(samples_col)).alias("__x"))
    base = base.withColumns({"n_samples": F.size(x).cast("long"), "rms": rms(x), "peak": peak(x), "mean": mean(x), "std": population_std(x), "crossings": zero_crossings(x).cast("long"), "norm_p95": norm_percentile(x)})
    base = base.withColumn("rail_run", F.when(F.col("peak") > 0, longest_run(x, F.col("peak") * rail)).otherwise(0).cast("long"))
    return base.withColumn("crossing_rate", F.when(F.col("n_samples") > 1, F.col("crossings") / (F.col("n_samples") - 1)).otherwise(0.0)).drop("__x")


# Thresholds of the detectors by sensitivity, and the ratios that a loud or faint trace must also pass.
THRESHOLDS = {
    "low": {"flat": 0.004, "dead": 0.04, "noise": 10.0, "crossing": 0.40, "hot": 9.0, "weak": 9.0, "rail": 0.05},
    "medium": {"flat": 0.010, "dead": 0.08, "noise": 8.0, "crossing": 0.34, "hot": 6.0, "weak": 6.0, "rail": 0.03},
    "high": {"flat": 0.020, "dead": 0.15, "noise": 6.0, "crossing": 0.28, "hot": 4.0, "weak": 4.0, "rail": 0.015},
}
HOT_RATIO, WEAK_RATIO, FLOOR = 2.5, 0.4, 0.05


def neighbour_scores(found: DataFrame, record: str, order: str, half: int = 6) -> DataFrame:
    """evidence -> adds local_median, local_mad, local_n, rms_z and ratio of each trace against the live traces around it.

    Neighbours are those within ``half`` places of the same record, without the trace itself; a trace is live if its std
    is above 0. Without any the record's median stands in, and the score's floor is 5 % of that median. A record must fit a task."""
    live = F.when((F.col("n_samples") > 0) & (F.col("std") > 0) & (F.col("peak") > 0), F.col("rms"))
    whole = F.percentile("__live", F.lit(0.5)).over(Window.partitionBy(record))
    rows = local_median(found.withColumn("__live", live), record, [order], "__live", half).withColumn("__whole", F.coalesce(whole, F.lit(0.0)))
    rows = rows.withColumns({"local_median": F.coalesce("local_median", "__whole"), "local_mad": F.coalesce("local_mad", F.lit(0.0))})
    spread = F.greatest(1.4826 * F.col("local_mad"), FLOOR * F.col("__whole"))
    return rows.withColumns({
        "rms_z": F.when(spread > 0, (F.col("rms") - F.col("local_median")) / spread).otherwise(0.0),
        "ratio": F.when(F.col("local_median") > 0, F.col("rms") / F.col("local_median"))}).drop("__live", "__whole")


def _within(x: Column) -> Column:
    return F.when(x > 1, 1.0).when(x < 0, 0.0).otherwise(x)


def classify(found: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """neighbour_scores -> detectors (the array of those that fire), class (the worst, or good) and severity (0 to 1).

    A dead trace is only dead; one without samples (or null) is dead. Of equal severities within 1e-9 clipped goes before noisy, noisy before amp. Needs at least
    three live neighbours to call a trace dead by its level."""
    t = THRESHOLDS[sensitivity]
    flat = F.when(F.col("peak") > 0, F.col("std") / F.col("peak")).otherwise(1.0)
    low = F.coalesce((F.col("local_n") >= 3) & (F.col("ratio") < t["dead"]), F.lit(False))
    empty, still = F.coalesce(F.col("n_samples") <= 0, F.lit(True)), (F.col("peak") > 0) & (flat <= t["flat"])
    dead = _within(F.greatest(F.when(F.col("peak") > 0, 1 - flat / t["flat"]).otherwise(0.0), F.when(low, 1 - F.col("ratio") / t["dead"]).otherwise(0.0), F.when(empty, 1.0).otherwise(0.0)))
    noisy = (F.col("rms_z") >= t["noise"]) & (F.col("crossing_rate") >= t["crossing"])
    hot = (F.col("rms_z") >= t["hot"]) & F.coalesce(F.col("ratio") >= HOT_RATIO, F.col("rms") > 0)
    weak = (F.col("rms_z") <= -t["weak"]) & F.coalesce(F.col("ratio") <= WEAK_RATIO, F.lit(False))
    railed = F.when(F.col("n_samples") > 0, F.col("rail_run") / F.col("n_samples")).otherwise(0.0)
    one = lambda name, fired, severity: F.when(fired, F.struct(F.lit(name).alias("name"), _within(severity).alias("severity")))
    others = F.array(
        one("clipped", (F.col("peak") > 0) & (railed >= t["rail"]), railed / (2 * t["rail"])), one("noisy", noisy, F.col("rms_z") / t["noise"] - 1),
        one("amp", hot | weak, F.abs("rms_z") / F.when(hot, t["hot"]).otherwise(t["weak"]) - 1))
    fired = F.when(empty | still | low, F.array(one("dead", F.lit(True), dead))).otherwise(F.array_compact(others))
    nothing = F.struct(F.lit("good").alias("name"), F.lit(-1.0).alias("severity"))
    worst = F.aggregate("__fired", nothing, lambda a, d: F.when(d["severity"] > a["severity"] + 1e-9, d).otherwise(a))
    out = found.withColumn("__fired", fired).withColumn("__worst", worst)
    return out.withColumns({"detectors": F.transform("__fired", lambda d: d["name"]), "class": F.col("__worst.name"), "severity": F.greatest(F.col("__worst.severity"), F.lit(0.0))}).drop("__fired", "__worst")


def gain_tpow(xs: Column, dt: float, t0: float, power: float) -> Column:
    return F.transform(xs, lambda x, i: F.when(F.lit(t0) + i * dt > 0, x * F.pow(F.lit(t0) + i * dt, F.lit(power))).otherwise(0.0))


def gain_epow(xs: Column, dt: float, t0: float, rate: float, power: float = 1.0) -> Column:
    return F.transform(xs, lambda x, i: F.when(F.lit(t0) + i * dt > 0, x * F.exp(F.lit(rate) * F.pow(F.lit(t0) + i * dt, F.lit(power)))).otherwise(x))


def gain_gpow(xs: Column, power: float) -> Column:
    return F.transform(xs, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(power)))


def gain_fixed(xs: Column, scale: float) -> Column:
    return F.transform(xs, lambda x: x * scale)


def gain_balance(xs: Column) -> Column:
    """By the trace's own rms; a trace of zeros stays."""
    return bound(rms(xs), lambda level: F.transform(xs, lambda x: F.when(level > 0, x / level).otherwise(x)))


def resample(xs: Column, length: int) -> Column:
    """Linear, with both end points kept."""
    return bound(xs, lambda held: _resampled(held, length))


def _resampled(xs: Column, length: int) -> Column:
    step = F.when(F.lit(length) > 1, (F.size(xs) - 1) / F.lit(max(1, length - 1))).otherwise(0.0)

    def at(i: Column) -> Column:
        place = i * step
        low = F.least(F.floor(place).cast("int"), F.size(xs) - 1)
        high = F.least(low + 1, F.size(xs) - 1)
        return F.element_at(xs, low + 1) + (F.element_at(xs, high + 1) - F.element_at(xs, low + 1)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def shift_up(xs: Column, by: Column) -> Column:
    """Samples moved earlier by a fractional number of places, by linear interpolation; zeros follow."""
    return bound(F.struct(xs.alias("xs"), by.alias("by")), lambda both: _shifted(both["xs"], both["by"]))


def _shifted(xs: Column, by: Column) -> Column:
    def at(_, i: Column) -> Column:
        place = i + by
        low = F.floor(place).cast("int")
        a = F.coalesce(F.try_element_at(xs, low + 1), F.lit(0.0))
        b = F.coalesce(F.try_element_at(xs, low + 2), F.lit(0.0))
        return F.when((place < 0) | (low >= F.size(xs)), 0.0).otherwise(a + (b - a) * (place - low))

    return F.transform(xs, at)


def reduced_time(xs: Column, offset: Column, velocity_km_s: float, dt: float) -> Column:
    """Moved up by |offset| / velocity; a trace without an offset stays."""
    return F.when(finite(offset), shift_up(xs, F.abs(offset) / (velocity_km_s * 1000.0) / dt)).otherwise(xs)


def decimate(xs: Column, points: int) -> Column:
    """(low, high) of points // 2 even buckets, for drawing; a short trace stays as pairs of itself."""
    return bound(xs, lambda held: _buckets(held, points))


def _buckets(xs: Column, points: int) -> Column:
    buckets = max(1, points // 2)
    step = F.size(xs) / F.lit(float(buckets))

    def pair(b: Column) -> Column:
        start = F.floor(b * step).cast("int")
        stop = F.greatest(F.floor((b + 1) * step).cast("int"), start + 1)
        part = F.slice(xs, start + 1, stop - start)
        return F.struct(F.array_min(part).alias("low"), F.array_max(part).alias("high"))

    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), pair))


def neighbour_levels(xs: np.ndarray, half: int, kind: str) -> np.ndarray:
    """The rms, mean or upper-median magnitude of each sample's neighbours within half."""
    n, at = len(xs), np.arange(len(xs))
    count = np.minimum(at + half, n - 1) - np.maximum(at - half, 0) + 1
    if not n:
        return xs
    if kind != "median":
        sums = np.concatenate([[0.0], np.cumsum(xs * xs if kind == "rms" else np.abs(xs))])
        at = np.arange(n)
        near = np.maximum(sums[np.minimum(n, at + half + 1)] - sums[np.maximum(0, at - half)], 0.0) / count
        return np.sqrt(near) if kind == "rms" else near
    wide = np.full(n + 2 * half, np.inf)  # what lies outside sorts last
    wide[half : half + n] = np.abs(xs)
    out = np.empty(n)
    step = max(1, (1 << 20) // (2 * half + 1))
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1)
    for i in range(0, n, step):
        ranked = np.sort(windows[i : i + step], axis=1)
        out[i : i + step] = np.take_along_axis(ranked, (count[i : i + step] // 2)[:, None], axis=1)[:, 0]
    return out


def gained(rows: list[np.ndarray], half: int, kind: str = "rms") -> list[np.ndarray]:
    """Each trace over its neighbours' levels; traces of one length at once."""
    if len({len(x) for x in rows}) == 1 and len(rows[0]) and kind != "median":
        x = np.stack(rows)
        n, at = x.shape[1], np.arange(x.shape[1])
        sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x if kind == "rms" else np.abs(x), axis=1)], axis=1)
        lo, hi = np.maximum(0, at - half), np.minimum(n, at + half + 1)
        level = np.maximum(sums[:, hi] - sums[:, lo], 0.0) / (hi - lo)
        level = np.sqrt(level) if kind == "rms" else level
        return list(np.where(level > 1e-10, x / np.where(level > 1e-10, level, 1.0), 0.0))
    out = []
    for x in rows:
        level = neighbour_levels(x, half, kind)
        out.append(np.where(level > 1e-10, x / np.where(level > 1e-10, level, 1.0), 0.0))
    return out


def automatic_gain(traces: DataFrame, id_col: str, samples_col: str, half: int, kind: str = "rms") -> DataFrame:
    """(id, i, x, gained): each sample over the rms, mean or upper-median magnitude of its neighbours within half."""

    def run(parts: pd.Series) -> pd.Series:
        at = [k for k, xs in enumerate(parts) if xs is not None]
        out: list = [None] * len(parts)
        for k, g in zip(at, gained([np.asarray(parts.iloc[k], float) for k in at], half, kind) if at else (), strict=True):
            out[k] = g
        return pd.Series(out, dtype=object)

    rows = traces.select(F.col(id_col), as_doubles(F.col(samples_col)).alias("x"))
    rows = rows.withColumn("gained", F.pandas_udf(run, "array<double>")("x"))
    return rows.select(id_col, F.posexplode(F.arrays_zip("x", "gained")).alias("i", "s")).select(id_col, "i", "s.x", "s.gained")


def first_pick(xs: np.ndarray, sta: int, lta: int, threshold: float, start: int, end: int | None = None) -> int | None:
    """The first sample from start to before end whose short window's mean energy reaches the threshold over that of the long window before it.

    None for traces that don't hold both windows. The long window is shorter near the trace's begin."""
    n = len(xs)
    if sta + lta >= n:
        return None
    sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(xs, posinf=0.0, neginf=0.0) ** 2)])
    mean = sums[-1] / n
    at = np.arange(max(start, sta), n if end is None else min(n, end))
    if not len(at):
        return None
    before = at - sta + 1  # end of the long window
    begin = np.maximum(0, before - lta)
    short, long = (sums[at + 1] - sums[before]) / sta, (sums[before] - sums[begin]) / (before - begin)
    hit = np.flatnonzero(short / np.maximum(long, 1e-4 * mean if mean > 0 else 1e-12) >= threshold)
    return int(at[hit[0]]) if len(hit) else None


def sta_lta(traces: DataFrame, id_col: str, samples_col: str, sta: int, lta: int, threshold: float, first: int | None = None) -> DataFrame:
    """(id, pick): the first sample at which the short mean energy, over the long one before it, reaches the threshold."""
    start = max(sta + 4, first or 0)

    def picks(parts: pd.Series) -> pd.Series:
        return parts.map(lambda xs: None if xs is None else first_pick(np.asarray(xs, float), sta, lta, threshold, start)).astype("Int64")

    return traces.select(id_col, F.pandas_udf(picks, "long")(as_doubles(F.col(samples_col))).alias("pick"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], samples_col: str) -> DataFrame:
    """Per key: rms of either trace and of a - b, and the gain of b over a (0 for a silent a); traces of one length."""
    a = left.select(*keys, as_doubles(F.col(samples_col)).alias("__a"))
    b = right.select(*keys, as_doubles(F.col(samples_col)).alias("__b"))
    rows = a.join(b, keys).withColumn("__d", F.zip_with("__a", "__b", lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    out = rows.select(*keys, rms(F.col("__a")).alias("rms_a"), rms(F.col("__b")).alias("rms_b"), rms(F.col("__d")).alias("rms_diff"))
    return out.withColumn("gain_ratio", F.when(F.col("rms_a") > 0, F.col("rms_b") / F.col("rms_a")).otherwise(0.0))


def semblance(gathers: DataFrame, gather_col: str, offset_col: str, samples_col: str, dt: float, velocities: list[float]) -> DataFrame:
    """(gather, velocity, i, value): (sum a)^2 / (n sum a^2) along the hyperbola of each velocity and zero-offset time."""
    rows = gathers.select(F.col(gather_col), F.abs(F.col(offset_col)).alias("__o"), as_doubles(F.col(samples_col)).alias("__x"))
    rows = rows.withColumn("velocity", F.explode(F.array(*[F.lit(float(v)) for v in velocities])))
    t0 = lambda i: i * F.lit(dt)
    picked = F.transform("__x", lambda _, i: F.try_element_at("__x", js_round(F.sqrt(t0(i) * t0(i) + F.pow(F.col("__o") / F.col("velocity"), F.lit(2.0))) / F.lit(dt)).cast("int") + 1))
    long = rows.select(gather_col, "velocity", F.posexplode(picked).alias("i", "a")).where("a IS NOT NULL")
    out = long.groupBy(gather_col, "velocity", "i").agg(F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("q"), F.count(F.lit(1)).alias("n"))
    return out.select(gather_col, "velocity", "i", F.when(F.col("q") > 1e-10, F.col("s") * F.col("s") / (F.col("n") * F.col("q"))).otherwise(0.0).alias("value"))
