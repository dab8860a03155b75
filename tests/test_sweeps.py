"""Sweeps: closed forms, faults, wavelets and planted harmonics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotframe.operators import sweeps


def linear(f0=8.0, f1=80.0, ms=4000.0, rate=1000.0, **more):
    given = dict(kind="linear", f0=f0, f1=f1, ms=ms, slope=0.0, into=0.0, out=0.0, taper="cosine", phase_deg=0.0, amplitude=1.0, rate_hz=rate) | more
    return sweeps.design(**given)


def test_closed_forms():
    x = linear()
    t = np.arange(4001) / 1000
    assert np.allclose(x["frequency"], 8 + 18 * t) and np.allclose(x["samples"], np.cos(2 * np.pi * (8 * t + 9 * t * t)), atol=1e-9)
    logarithmic = sweeps.frequency("dboct", 5.0, 80.0, np.linspace(0, 1, 5), -10 / np.log2(10))
    assert np.allclose(logarithmic, [5, 10, 20, 40, 80])
    for kind in sweeps.SLOPES:
        f = sweeps.frequency(kind, 7.0, 90.0, np.array([-1, 0, 0.5, 1, 2]), sweeps.SLOPES[kind])
        assert f[0] == pytest.approx(7) and f[1] == pytest.approx(7) and f[3] == pytest.approx(90) and f[4] == pytest.approx(90) and 7 < f[2] < 90
    tapered = linear(into=500.0, out=300.0, taper="blackman", amplitude=0.5)["envelope"]
    assert tapered[0] == pytest.approx(0, abs=1e-12) and tapered[250] == pytest.approx(0.5 * 0.34) and tapered[2000] == 0.5 and tapered[-1] == pytest.approx(0, abs=1e-12)


def test_designs_and_faults(spark):
    schema = "sweep int, kind string, f0 double, f1 double, ms double, slope double, taper_in_ms double, taper_out_ms double, taper string, phase_deg double, amplitude double"
    rows = [(1, None, 8.0, 80.0, 1000.0, *[None] * 6), (2, "dbhz", 8.0, 80.0, 1000.0, 11.0, *[None] * 5), (3, "square", 0.0, 600.0, 0.0, None, 5.0, 5.0, None, None, 2.0), (4, "linear", None, 80.0, 1000.0, *[None] * 6)]
    got = {r.sweep: r for r in sweeps.designs(spark.createDataFrame(rows, schema), 1000.0).collect()}
    assert got[1].faults == [] and len(got[1].samples) == 1001 and got[2].faults == ["slope"] and got[2].samples is None
    assert set(got[3].faults) == {"kind", "f0", "length", "taper", "amplitude", "nyquist"} and got[4].faults == ["f0"]
    assert sweeps.designs(spark.createDataFrame([], schema), 1000.0).count() == 0


def test_klauder_wavelets():
    db, lobe = sweeps.klauder_of(linear(into=300.0, out=300.0)["samples"], 1000.0)
    assert 6 < db < 40 and 8 <= lobe <= 14  # about 1 / (2 * 44 Hz) between the changes of sign
    assert sweeps.klauder_of(np.empty(0), 1000.0) == (0.0, 0.0) and sweeps.klauder_of(np.ones(50), 1000.0) == (120.0, 0.0)


def test_planted_harmonic(spark):
    made = linear(f0=10.0, f1=60.0, ms=8000.0)
    phase = np.radians(made["phase_deg"])
    clean, second = np.cos(phase), np.cos(phase) + 0.1 * np.cos(2 * phase)
    df = spark.createDataFrame([(1, clean.tolist(), made["frequency"].tolist()), (2, second.tolist(), made["frequency"].tolist()), (3, None, None)], "i int, x array<double>, f array<double>")
    got = {r.i: r.d for r in df.select("i", sweeps.distortion(F.col("x"), F.col("f"), 1000.0).alias("d")).collect()}
    assert got[1].average < 1.5 and 8 < got[2].average < 12 and len(got[2].series) > 30 and (got[3].average, got[3].most, got[3].series) == (0.0, 0.0, [])
