"""Assisted picks against a plain reading of the rules over whole gathers, and the geometry cascade against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest

from shotframe.operators import firstbreak, geometry
from shotframe.operators.firstbreak import Options


def rnd(x):
    return math.floor(x + 0.5)


def plain_assist(gather, seeds, si, o):
    """gather: [(trace, offset, samples)]; seeds: [(trace, ms)]; sample by sample."""
    dt = si / 1000
    cond, level = {}, {}
    for t, _, x in gather:
        level[t] = math.sqrt(sum(v * v for v in x) / len(x)) if x else 0.0
        half = max(1, rnd(o.gain_ms * 500 / si))
        cond[t] = []
        for i in range(len(x)):
            w = x[max(0, i - half) : i + half + 1]
            r = math.sqrt(sum(v * v for v in w) / len(w))
            cond[t].append(x[i] / r if r > 1e-10 else 0.0)
    live = [v for v in level.values() if v > 0]
    mid = statistics.median(live) if live else 0
    dead = {t: level[t] <= 0 or (mid > 0 and level[t] < o.dead_share * mid) for t in level}
    by_offset = sum(off is not None for _, off, _ in gather) > len(gather) / 2
    key = {t: abs(off) if by_offset and off is not None else float(t) for t, off, _ in gather}
    pairs = []
    for k, t, s in sorted((key[t], t, s) for t, s in seeds if t in key):
        if pairs and abs(k - pairs[-1][0]) < 1e-9:
            pairs[-1][1] = (pairs[-1][1] + s) / 2
        else:
            pairs.append([k, s])
    own = {}
    for t, s in seeds:
        if t in key:
            own[t] = max(own.get(t, -math.inf), s)
    if len(pairs) < 2:
        return {t: (s, "seed", 1.0, 0.0) for t, s in own.items()}

    def guide(k):
        j = 0
        while j < len(pairs) - 2 and k > pairs[j + 1][0]:
            j += 1
        (a, u), (b, v) = pairs[j], pairs[j + 1]
        return u + (v - u) / (b - a) * (k - a)

    half = max(2, rnd(o.wavelet_ms / dt))
    window = lambda x, c: [x[rnd(c) + j] if 0 <= rnd(c) + j < len(x) else 0.0 for j in range(-half, half + 1)]
    _, t0, s0 = min((key[t], t, s) for t, s in seeds if t in key and cond[t])
    ref = window(cond[t0], s0 / dt)

    def pick(x, lo, hi):
        sta = max(1, rnd(o.sta_ms / dt))
        lta = max(sta + 1, rnd(o.lta_ms / dt))
        if sta + lta >= len(x):
            return None, 0.0
        floor_ = max(1e-4 * sum(v * v for v in x) / len(x), 1e-300) or 1e-12
        end = min(len(x), math.ceil(hi / dt)) if hi > 0 else len(x)
        for i in range(max(sta + 4, math.floor(lo / dt) if lo > 0 else 0), end):
            a = sum(v * v for v in x[i + 1 - sta : i + 1]) / sta
            before = x[max(0, i - sta - lta + 1) : i - sta + 1]
            if a / max(sum(v * v for v in before) / len(before), floor_) >= o.threshold:
                break
        else:
            return None, 0.0
        t = i * dt
        w = window(x, t / dt)
        norm = math.sqrt(sum(v * v for v in w) * sum(v * v for v in ref)) or 1
        best, lag = 0.0, 0
        for m in range(-2 * half, 2 * half + 1):
            c = sum(w[j + m] * ref[j] for j in range(2 * half + 1) if 0 <= j + m <= 2 * half) / norm
            if abs(c) > abs(best) + 1e-9:
                best, lag = c, m
        t = max(lo, min(hi, t + lag * dt))
        reach, c = max(2, min(40, rnd(half / 2))), rnd(t / dt)
        if 0 <= c < len(x) and max(1, c - reach) <= min(len(x) - 2, c + reach):
            i = max(range(max(1, c - reach), min(len(x) - 2, c + reach) + 1), key=lambda i: (x[i], -i))
            d = x[i - 1] - 2 * x[i] + x[i + 1]
            step = 0.5 * (x[i - 1] - x[i + 1]) / d if d else 0
            t = (i + (step if abs(step) <= 1 else 0)) * dt
        return max(lo, min(hi, t)), min(1, abs(best))

    out = {}
    for t in key:
        if t in own:
            out[t] = [own[t], "seed", 1.0, 0.0]
        else:
            g = guide(key[t])
            ms, conf = (None, 0.0) if dead[t] else pick(cond[t], g - o.window_ms, g + o.window_ms)
            out[t] = [ms, "auto", conf, 0.0]
    res = [v[0] - guide(key[t]) for t, v in out.items() if v[1] == "auto" and v[0] is not None]
    trend = statistics.median(res) if res else 0
    sigma = 1.4826 * statistics.median([abs(r - trend) for r in res]) if res else 0
    for t, v in out.items():
        if v[1] == "auto" and v[0] is not None and sigma > 0:
            dev = v[0] - guide(key[t]) - trend
            if abs(dev) > o.outlier * sigma:
                g = guide(key[t]) + trend
                ms, conf = pick(cond[t], g - o.window_ms / 2, g + o.window_ms / 2)
                if ms is not None:
                    v[0], v[2] = ms, conf
                    dev = ms - guide(key[t]) - trend
                if abs(dev) > o.outlier * sigma:
                    v[2] *= 0.5
            v[3] = dev
    return {t: tuple(v) for t, v in out.items()}


def test_assisted_picks_against_the_rules(spark):
    r = random.Random(12)
    o, si, rows, seeds, want = Options(sta_ms=8, lta_ms=40, wavelet_ms=10, gain_ms=60, window_ms=20, outlier=3), 2000.0, [], [], {}
    for g in range(8):
        gather, own = [], []
        for k in range(24):
            onset = 40 + k
            x = [r.gauss(0, 0.02) if i < onset else math.sin((i - onset) / 2.2) * math.exp(-(i - onset) / 40) + r.gauss(0, 0.1) for i in range(120)]
            if k % 9 == 4:
                x = [v * 1e-4 for v in x] if g % 2 else []
            if k == 17:
                x = [r.gauss(0, 1) for _ in x]
            off = None if g == 2 or (g == 3 and k % 3 == 0) else (k * 12.5 - 30 if g != 4 else abs(k - 12) * 10.0)
            gather.append((g * 100 + k, off, x))
            if k in ((3, 20) if g == 5 else (3,) if g == 6 else () if g == 7 else (2, 11, 21)):
                own.append((g * 100 + k, onset * 2.0 + 4))
        rows += [(g, t, off, x) for t, off, x in gather]
        seeds += [(g, t, s) for t, s in own]
        want |= {(g, t): v for t, v in plain_assist(gather, own, si, o).items()}
    seeds += [(0, 999, 5.0), (1, 105, None), (1, 107, float("nan"))]
    df = spark.createDataFrame(rows, "gather int, trace int, offset double, samples array<double>")
    got = {(p.gather, p.trace): (p.ms, p.source, p.confidence, p.deviation) for p in firstbreak.assist(df, spark.createDataFrame(seeds, "gather int, trace int, ms double"), si, o).collect()}
    assert set(got) == set(want) and sum(v[0] is not None and v[1] == "auto" for v in got.values()) > 60
    for k, (ms, source, conf, dev) in want.items():
        assert got[k][1] == source and (ms is None) == (got[k][0] is None), k
        assert ms is None or got[k][0] == pytest.approx(ms, abs=1e-6), k
        assert got[k][2:] == pytest.approx((conf, dev), abs=1e-6), k


def test_phases():
    x = np.sin(np.arange(100) / 5)
    assert firstbreak.snapped(x, 80.0, 10_000.0, "peak", 5) == pytest.approx(10 * 2.5 * math.pi, abs=1) and firstbreak.snapped(x, 240.0, 10_000.0, "trough", 5) == pytest.approx(10 * 7.5 * math.pi, abs=1)
    assert firstbreak.snapped(x, 150.0, 10_000.0, "zero", 5) == pytest.approx(50 * math.pi, abs=1) and firstbreak.snapped(np.ones(10), 50.0, 10_000.0, "zero", 3) == 50.0
    assert firstbreak.snapped(x, 5000.0, 10_000.0, "peak", 3) == 5000.0 and firstbreak.around(np.arange(5.0), -9, 2).tolist() == [0] * 5 and firstbreak.around(np.arange(5.0), 0, 2).tolist() == [0, 0, 0, 1, 2]


def test_geometry_states_and_empty_tables(spark):
    kind = "trace long, ffid long, source_point long, source_x long, source_y long, receiver_x long, receiver_y long, coordinate_scalar int"
    stations = spark.createDataFrame([(1, 1, 0.0, 100.0, 1.0), (1, 2, 50.0, 100.0, None), (1, 3, 50.5, 100.0, 1.0)], "line int, point int, x double, y double, elevation double")
    none = spark.createDataFrame([], kind)
    assert [tuple(r) for r in geometry.check(none, stations, stations).collect()] == [("Coverage", "info", 0)]
    same = spark.createDataFrame([(k, k, 1, 0, 100, 0, 100, 1) for k in range(10)], kind)
    got = {r.category: r.n for r in geometry.check(same, stations, stations).collect()}
    assert got == {"StackState": 1, "MissingStation": 2}
    bare = spark.createDataFrame([(k, k, 1, 0, 0, None, 0, None) for k in range(10)], kind)
    assert {r.category: r.n for r in geometry.check(bare, stations, stations, sorting=1).collect()} == {"SourceCoverage": 0, "ReceiverCoverage": 0}
    tie = spark.createDataFrame([(1, 1, 9, 5025, 10_000, 4900, 10_000, -100)], kind)
    shot = geometry.match_sources(geometry.placed(tie), stations).first()
    assert (shot.outcome, shot.point) == ("numbering", 2)
    loaded = geometry.load(tie, stations, stations, scalar=-10_000).first()
    assert (loaded.source_x, loaded.receiver_x, loaded.source_elevation, loaded.receiver_elevation, loaded.offset, loaded.coordinate_scalar) == (500_000, 500_000, None, None, 0, -10_000)
    untouched = geometry.load(spark.createDataFrame([(1, 1, 9, 7, 7, 8, 8, -10)], kind), stations, stations).first()
    assert (untouched.source_x, untouched.receiver_y, untouched.coordinate_scalar, untouched.offset) == (7, 8, -10, None)
