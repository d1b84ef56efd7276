"""Operators against numpy, edge cases and argument checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dynspec import meta
from dynspec.functions import columns as C
from dynspec.model import explode_spectra, pack_spectra
from dynspec.operators import filterbank as fbk
from dynspec.operators import folded, matched, rfi, robust, series, simulate, spectrum
from dynspec.plans import search
from dynspec.streaming import windows

HEAD = meta.ObsHeader(nchans=16, fch1=1400.0, foff=-4.0, tsamp=0.001, nsamples=300, tstart=58000.0)
RNG = np.random.default_rng(11)
X = RNG.normal(5, 2, (300, 16))


@pytest.fixture(scope="module")
def spectra(spark):
    return spark.createDataFrame([("a", t, row.tolist()) for t, row in enumerate(X)], "obs_id string, t long, spec array<double>")


def series_of(spark, x, obs="a"):
    return spark.createDataFrame([(obs, i, float(v)) for i, v in enumerate(x)], "obs_id string, t long, v double")


def values(df, key="t"):
    return np.array([r.v for r in df.orderBy(key).collect()])


def test_pack_inverts_explode(spectra):
    got = np.array([r.spec for r in pack_spectra(explode_spectra(spectra)).orderBy("t").collect()])
    assert (got == X).all()


@pytest.mark.parametrize("ref", ["fch1", "fmin", "fcenter"])
def test_dedisperse_any_reference(spectra, ref):
    d = HEAD.delays(300.0, ref)
    low, high = fbk.valid_range(d, 300)
    want = [sum(X[t + d[c], c] for c in range(16)) for t in range(low, high)]
    assert np.allclose(values(fbk.dedisperse(spectra, HEAD, 300.0, ref)), want)


def test_dispersion_limits(spectra):
    with pytest.raises(ValueError):
        fbk.dedisperse(spectra, HEAD, 1e6)
    with pytest.raises(ValueError):
        fbk.subband(spectra, HEAD, 10, 5)
    with pytest.raises(ValueError):
        fbk.read_dedisp_block(explode_spectra(spectra), HEAD, 290, 20, 300.0)
    with pytest.raises(ValueError):
        HEAD.reference("nowhere")


def test_impulse_comes_back(spark):
    d = HEAD.delays(300.0)
    rows = [("a", t, [1.0 if t == 100 + d[c] else 0.0 for c in range(16)]) for t in range(300)]
    v = values(fbk.dedisperse(spark.createDataFrame(rows, "obs_id string, t long, spec array<double>"), HEAD, 300.0))
    assert v[100] == 16 and v.sum() == 16


def test_fold_counts_and_gaps(spectra):
    cube = fbk.fold(spectra, HEAD, 0.03, 50.0, 0.0, 6, 4, 4).toPandas()
    assert len(cube) == 4 * 4 * 6 and cube.n.sum() == 16 * (300 - HEAD.delays(50.0).max())
    with pytest.raises(ValueError):
        fbk.fold(spectra, HEAD, 0.03, 50.0, nbins=300)


@pytest.mark.parametrize("window", [1, 3, 4, 11])
@pytest.mark.parametrize("method", ["mean", "median"])
def test_running_filter_reflects(spark, window, method, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 40)
    x = RNG.normal(size=150)
    p = np.pad(x, window, "symmetric")
    before = window // 2
    want = [getattr(np, method)(p[window + i - before : window + i - before + window]) for i in range(150)]
    assert np.allclose(values(series.running_filter(series_of(spark, x), 150, window, method)), want)


def test_running_filter_golden(spark):
    x = series_of(spark, range(1, 11))
    assert np.round(values(series.running_filter(x, 10, 3)), 1).tolist() == [1.3, 2, 3, 4, 5, 6, 7, 8, 9, 9.7]
    assert np.round(values(series.running_filter(x, 10, 4)), 2).tolist() == [1.5, 1.75, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.25]
    with pytest.raises(ValueError):
        series.running_filter(x, 10, 0)


def test_correlate(spark):
    a, b = RNG.normal(size=50), RNG.normal(size=20)
    got = series.correlate(series_of(spark, a), series_of(spark, b)).orderBy("lag").toPandas()
    assert np.allclose(got.v, np.correlate(a, b, "full")) and got.lag.tolist() == list(range(-19, 50))


@pytest.mark.parametrize("n", [64, 125])
def test_transform_round_trip(spark, n):
    x = RNG.normal(size=n)
    f = series.rfft(series_of(spark, x))
    assert np.allclose(values(spectrum.ifft(f, n)), x)


def test_resample_is_the_loop(spark):
    x = RNG.normal(size=200)
    for accel in (-3e8, 0.0, 3e8):
        total = 199 if accel > 0 else 200
        p = accel * 0.001 / (2 * meta.LIGHT_SPEED)
        want, last = np.zeros(total), 0
        for i in range(total):
            at = int(i + p * (i - total // 2) ** 2 - p * (total // 2) ** 2)
            if 0 <= at < total:
                want[at] = x[i]
            if at - last > 1 and 0 <= at - 1 < total:
                want[at - 1] = x[i]
            last = at
        got = values(series.resample(series_of(spark, x), HEAD.updated(nsamples=200), accel))
        assert np.allclose(got, want)


@pytest.mark.parametrize("method", ["std", "iqr", "mad", "diffcov", "biweight", "qn", "sn", "gapper"])
def test_scales_of_normal_values(spark, method):
    x = np.random.default_rng(42).normal(5, 2, 400)
    rows = series_of(spark, x)
    got = robust.scale(rows, ["obs_id"], method).first().scale
    assert got == pytest.approx(2, rel=0.2)
    flat = robust.zscore(series_of(spark, [3.0] * 9), ["obs_id"], "median", "mad").toPandas()
    assert (flat.z == 0).all() and (flat.scale == 1).all()


def test_unknown_methods_are_refused(spark):
    x = series_of(spark, [1.0, 2.0])
    for call in (lambda: robust.scale(x, ["obs_id"], "no"), lambda: robust.location(x, ["obs_id"], "no"), lambda: fbk.collapse(x, "no"), lambda: rfi.double_mad_mask(x, threshold=0)):
        with pytest.raises(ValueError):
            call()


def test_masks_find_outliers(spark):
    v = RNG.normal(0, 1, 64)
    v[[7, 40]] = 50
    rows = spark.createDataFrame([("a", c, float(x)) for c, x in enumerate(v)], "obs_id string, c int, v double")
    for made in (rfi.double_mad_mask(rows, threshold=6), rfi.iqrm_mask(rows, threshold=6)):
        assert {7, 40} <= {r.c for r in made.where("masked").collect()}


def test_clean_uses_custom_and_ranges(spectra):
    cells, mask = rfi.clean(explode_spectra(spectra), HEAD, "mad", 20.0, [(1396, 1396)], lambda m: np.arange(16) == 9, -1.0)
    assert {r.c for r in mask.where("masked").collect()} == {1, 9}
    assert {r.c for r in cells.where("v = -1").collect()} == {1, 9}


def test_matched_filter_finds_pulses(spark):
    x = RNG.normal(0, 0.1, 256)
    x[100:108] += 1.0
    best = matched.best_pulse(matched.boxcar_snr(series_of(spark, x), 256)).first()
    assert best.width in (6, 9) and abs(best.peak_bin - 100) <= 2
    y = RNG.normal(0, 0.1, 250) + meta.gaussian(np.arange(250), 60, 10)
    for kind in ("gaussian", "lorentzian", "boxcar"):
        best = matched.best_pulse(matched.matched_filter(series_of(spark, y), kind)).first()
        assert best.snr > 5 and abs(best.peak_bin - 60) <= 8
    z = robust.zscore(series_of(spark, x), ["obs_id"], "median", "iqr").orderBy("t").toPandas().z.to_numpy()
    whole = matched.convolve(z, matched.templates("boxcar"))
    got = matched.boxcar_snr(series_of(spark, x), 256).orderBy("itemp", "t").toPandas().snr.to_numpy().reshape(whole.shape)
    assert np.allclose(got, whole)


def test_fourier_deredden_is_the_loop(spark):
    n = 401
    f = RNG.normal(size=n) + 1j * RNG.normal(size=n)
    rows = spark.createDataFrame([("a", k, float(z.real), float(z.imag)) for k, z in enumerate(f)], "obs_id string, k long, re double, im double")
    head = HEAD.updated(nsamples=800)
    got = spectrum.deredden(rows, head, n, 6, 100, 60.0).orderBy("k").toPandas()
    blocks = spectrum.deredden_blocks(n, head.tobs, 6, 100, 60.0)
    power, want = np.abs(f) ** 2, np.ones(n, complex)
    means = [np.median(power[a : a + w]) / np.log(2) for a, w in blocks]
    for i, (a, w) in enumerate(blocks):
        for j in range(w):
            level = means[i]
            if i + 1 < len(blocks):
                both = w + blocks[i + 1][1]
                level += (means[i + 1] - means[i]) / both * (both / 2 - j)
            want[a + j] = f[a + j] / np.sqrt(level)
    assert np.allclose(got.re + 1j * got.im, want)


def test_search_finds_a_period(spark):
    t = np.arange(2000)
    pulse = (t % 50 < 3) * 3.0
    d = HEAD.delays(100.0)
    x = RNG.normal(0, 1, (2000, 16))
    for c in range(16):
        x[:, c] += np.roll(pulse, d[c])
    sp = spark.createDataFrame([("a", i, row.tolist()) for i, row in enumerate(x)], "obs_id string, t long, spec array<double>")
    head = HEAD.updated(nsamples=2000)
    found = search.periodicity(sp, head, 100.0, 2, 3).where("nfold = 0").toPandas()
    assert any(abs(fr / 20 - round(fr / 20)) < 0.05 for fr in found.freq)
    cube, snr = search.fold_candidate(sp, head, 0.05, 100.0, 25, 4, 4)
    assert snr.first().snr > 5 and abs(snr.first().peak_bin - 12) <= 3
    moved = folded.update_period(cube, head.updated(period=0.05), 0.0501, 4, 25)
    assert moved.count() == cube.count()


def test_pulse_window_pads(spectra):
    w = search.PulseWindow(HEAD, toa=20, width=4, dm=10.0, min_nsamps=64)
    got = w.data(spectra).toPandas()
    assert w.start < 0 and len(got) == w.nsamps * 16
    assert got[(got.t == -w.start) & (got.c == 3)].v.iloc[0] == X[0, 3]


def test_spectral_structures():
    freqs = np.linspace(1500.0, 1400.0, 512)
    for kind in simulate.KINDS:
        for seed in range(5):
            s = simulate.spectral_structure(freqs, kind, 0.0, seed)
            assert s.shape == (512,) and s.mean() == pytest.approx(1) and (s >= 0).all() and np.isfinite(s).all()
            assert (s == simulate.spectral_structure(freqs, kind, 0.0, seed)).all()
    assert (simulate.spectral_structure(freqs, "flat", 0.0) == 1).all()
    slope = simulate.spectral_structure(freqs, "power_law", -2.0)
    assert np.allclose(slope / slope[0], (freqs / freqs[0]) ** -2)
    peak = simulate.spectral_structure(freqs, "gaussian", 0.0, 1, simulate.Structure(centre=0.25, width=0.1))
    assert abs(freqs[peak.argmax()] - 1425) < 1 and (peak > peak.max() / 2).mean() == pytest.approx(0.1, abs=0.01)
    # Scattered light has exponential power: its deviation is its mean; a wider decorrelation leaves fewer extremes.
    many = np.concatenate([simulate.spectral_structure(freqs, "scintillation", 0.0, i, simulate.Structure(decorrelation=0.01)) for i in range(40)])
    assert many.std() == pytest.approx(1, abs=0.15)
    turns = lambda width: np.mean([(np.diff(np.sign(np.diff(simulate.spectral_structure(freqs, "scintillation", 0.0, i, simulate.Structure(decorrelation=width))))) != 0).sum() for i in range(20)])
    assert turns(0.01) > 3 * turns(0.1)
    with pytest.raises(ValueError):
        simulate.spectral_structure(freqs, "invalid")


def test_burst(spark):
    head = meta.ObsHeader(nchans=32, fch1=1500.0, foff=-1.0, tsamp=0.001, nsamples=512)
    params = simulate.PulseParams(dm=50.0, tau_ms=1.0, structure="gaussian", seed=1)
    cells = simulate.burst(spark, head, params, 512)
    assert cells.count() == 32 * 512
    tim = fbk.dedisperse(pack_spectra(cells), head, 50.0)
    n = 512 - int(head.delays(50.0).max())
    best = matched.best_pulse(matched.boxcar_snr(tim, n)).first()
    assert abs(best.peak_bin + best.width / 2 - 256) < 8
    stats = simulate.burst_stats(tim, head, params, n).first()
    assert stats.norm == pytest.approx(10 * np.sqrt(32), rel=0.05) and stats.template_snr == pytest.approx(10, rel=0.05)
    assert 7 < stats.box_snr <= 10.01 and 7 < stats.gauss_snr <= 10.01 and stats.box_width >= 2
    assert stats.eff_width == pytest.approx(np.sqrt(0.001**2 + 0.001**2 + 0.002**2 + head.smearing(50.0, in_samples=False).max() ** 2))
    fine = simulate.burst(spark, head, simulate.PulseParams(dm=50.0, tau_ms=1.0, structure="gaussian", seed=1, oversample=8), 512)
    tim8 = values(fbk.dedisperse(pack_spectra(fine), head, 50.0))
    assert np.sqrt((tim8**2).sum()) == pytest.approx(10 * np.sqrt(32), rel=0.1) and np.corrcoef(tim8, values(tim))[0, 1] > 0.9
    shifted = simulate.disperse(cells.where("t < 10"), [0] * 32, 30)
    assert shifted.count() == 32 * 30


def test_disperse_moves_and_averages(spark):
    rows = [("a", t, c, float(10 * t + c)) for t in range(4) for c in range(3)]
    fb = spark.createDataFrame(rows, "obs_id string, t long, c int, v double")
    want = np.zeros((3, 20))
    for c, shift in enumerate((-2, 0, 3)):
        want[c, 8 + shift : 12 + shift] = [10 * t + c for t in range(4)]
    got = simulate.disperse(fb, [-2, 0, 3], 20).toPandas().pivot(index="c", columns="t", values="v").to_numpy()
    assert np.array_equal(got, want)
    got = simulate.disperse(fb, [-2, 0, 3], 20, 4).toPandas().pivot(index="c", columns="t", values="v").to_numpy()
    assert np.allclose(got, want.reshape(3, 5, 4).mean(axis=2))


def test_model_and_on_pulse(spark):
    best = spark.createDataFrame([("a", 3, 5.0, 10, 7.0)], "obs_id string, itemp int, width double, peak_bin long, snr double")
    model = values(matched.best_model(best, "boxcar", 20))
    assert len(model) == 20 and (model[10:15] > 0).all() and (np.delete(model, range(10, 15)) < 0).all()
    assert model.mean() == pytest.approx(0) and (model**2).sum() == pytest.approx(1)
    assert values(matched.best_model(best, "gaussian", 40)).argmax() == 10
    assert matched.on_pulse(best, "boxcar", 20).first()[-2:] == (10, 15) and matched.on_pulse(best, "gaussian", 20).first()[-2:] == (5, 15)
    assert matched.on_pulse(best, "boxcar", 12).first()[-2:] == (10, 12)


def test_merged_statistics_keep_large_means(spark):
    x = 1e8 + np.random.default_rng(4).normal(size=3000)
    fb = spark.createDataFrame([("a", t, 0, float(v)) for t, v in enumerate(x)], "obs_id string, t long, c int, v double").withColumn("part", F.col("t") % 5)
    got = fbk.merge_stats(fbk.partial_stats(fb, "part")).first()
    d = x - x.mean()
    assert got["var"] == pytest.approx(x.var(), rel=1e-6) and got["skew"] == pytest.approx((d**3).mean() / x.var() ** 1.5, abs=1e-5)
    assert got["kurt"] == pytest.approx((d**4).mean() / x.var() ** 2 - 3, abs=1e-5)


def test_pairs_of_large_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(robust, "MOST_PAIRED", 10)
    data = spark.range(20).selectExpr("'a' AS obs_id", "id AS t", "id * 1.0 AS v")
    with pytest.raises(Exception, match="too many to pair"):
        robust.scale(data, ["obs_id"], "qn").collect()


def test_frames_across_blocks(spark, monkeypatch):
    from dynspec.operators import series as se

    monkeypatch.setattr(se, "BLOCK", 64)
    x = np.random.default_rng(6).normal(size=500)
    tim = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "obs_id string, t long, v double")
    got = matched.boxcar_snr(tim, 500, 9).toPandas().sort_values(["itemp", "t"])
    z = (x - np.median(x)) / ((np.quantile(x, 0.75) - np.quantile(x, 0.25)) / robust.IQR_NORMAL)
    for i, w in enumerate(meta.width_ladder(9)):
        want = (np.array([np.take(z, range(t, t + w), mode="wrap").sum() for t in range(500)]) - w * z.mean()) / np.sqrt(w * (1 - w / 500))
        assert np.allclose(got[got.itemp == i].snr, want)
    last = se.lagged(tim, "t", ["v"], F.lit(0.0)).toPandas().sort_values("t")
    assert np.array_equal(last.last_v, np.concatenate([[0], x[:-1]]))


def test_header():
    assert HEAD.updated(nonsense=1, dm=3.0).dm == 3.0
    assert HEAD.fbottom == HEAD.ftop - 64 and HEAD.fcenter == (HEAD.ftop + HEAD.fbottom) / 2
    assert meta.parse_angle(meta.pack_angle(83.633, True), True) == pytest.approx(83.633, abs=1e-6)
    assert meta.format_angle(-8.7954851) == "-08:47:43.7464"
    assert meta.width_ladder(32) == [1, 2, 3, 4, 6, 9, 13, 19, 28]
    assert [meta.good_size(n) for n in (7, 11, 121, 250)] == [8, 12, 125, 250] and meta.good_size(121, 11) == 121
    assert meta.nearest_factor(100, 7) == 5 and meta.next_power_of_two(17) == 32 and meta.next_multiple(17, 5) == 20
    assert meta.pad_centre(np.ones((2, 3)), 5).tolist() == [[0, 1, 1, 1, 0]] * 2
    assert "bandwidth" in HEAD.to_string() and HEAD.obs_date.startswith("2017-09-04")
    assert meta.duration_string(7200) == "2.0 hours"


def test_angle_columns(spark):
    row = spark.range(1).select(C.packed_angle(F.lit(-22.0144)).alias("a"), C.angle_degrees(C.packed_angle(F.lit(83.633), True), True).alias("b")).first()
    assert row.a == pytest.approx(meta.pack_angle(-22.0144)) and row.b == pytest.approx(83.633)


def test_running_rescale(spark, spectra):
    got = windows.rescale(explode_spectra(spectra)).where("c = 3 AND t = 99").first().v
    assert got == pytest.approx((X[99, 3] - X[:100, 3].mean()) / X[:100, 3].std())


def test_streams(spark, spectra, tmp_path):
    for i in range(3):
        spectra.where(f"t >= {100 * i} AND t < {100 * i + 100}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("obs_id string, t long, spec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windows.dedisperse_stream(stream, HEAD, 300.0).writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = values(spark.table("dd")), values(fbk.dedisperse(spectra, HEAD, 300.0))
    assert np.allclose(got, want)
    q = windows.rescale_stream(explode_spectra(stream), 50).writeStream.format("memory").queryName("rs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = values(spark.table("rs").where("c = 2 AND t < 100"))
    assert np.allclose(first, (X[:100, 2] - X[:100, 2].mean()) / X[:100, 2].std())


def test_event_windows_batch_equals_stream(spark, tmp_path):
    import os

    src = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(src):
        pytest.skip("no test tables")
    batch = windows.windowed_stats(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))).toPandas()
    os.makedirs(tmp_path / "ev")
    os.symlink(src, tmp_path / "ev/events.parquet")
    q = windows.windowed_stats(windows.read_events(spark, str(tmp_path / "ev"))).writeStream.format("memory").queryName("ev").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = spark.table("ev").toPandas()
    assert len(live) == len(batch) and live.total.sum() == pytest.approx(batch.total.sum())
    assert windows.session_stats(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == batch.n.sum()
