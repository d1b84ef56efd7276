"""Synthetic bursts: a pulse with a spectral structure, smeared, scattered and dispersed into a block.

Random numbers are numpy's, on the driver, seeded: one value a channel. Channels are made in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import ObsHeader, gaussian
from . import matched

@dataclass(frozen=True)
class Structure:
    """How a burst's power is spread over the band. Widths are shares of the band; a centre that is not given is drawn evenly from the band."""

    centre: float | None = None
    width: float = 0.35  # of an envelope from end to end, of a peak at half its height
    decorrelation: float = 0.05  # over which scintillation changes
    paths: int = 48  # that scattered light takes
    patches: float = 4.0  # on average
    degree: int = 5  # of the polynomial


def _envelope(x: np.ndarray, how: Structure, rng: np.random.Generator) -> np.ndarray:
    """A Hann window: a smooth hump that ends at zero."""
    middle = rng.random() if how.centre is None else how.centre
    return np.where(np.abs(x - middle) < how.width, np.cos(np.pi * (x - middle) / (2 * how.width)) ** 2, 0.0)


def _peak(x: np.ndarray, how: Structure, rng: np.random.Generator) -> np.ndarray:
    """Emission limited to a band, as repeating sources show."""
    return gaussian(x, rng.random() if how.centre is None else how.centre, how.width)


def _polynomial(x: np.ndarray, how: Structure, rng: np.random.Generator) -> np.ndarray:
    """The square of a random Legendre series whose higher terms are weaker."""
    strengths = rng.standard_normal(how.degree + 1) / np.sqrt(np.arange(how.degree + 1) + 1)
    return np.polynomial.legendre.legval(2 * x - 1, strengths) ** 2


def _scintillation(x: np.ndarray, how: Structure, rng: np.random.Generator) -> np.ndarray:
    """Power of light that comes by many paths: their delays fall off exponentially, and their interference changes over the decorrelation width."""
    delays = rng.exponential(1 / (2 * np.pi * how.decorrelation), how.paths)
    field = rng.standard_normal(how.paths) + 1j * rng.standard_normal(how.paths)
    return np.abs(np.exp(2j * np.pi * np.multiply.outer(x, delays)) @ field) ** 2


def _patches(x: np.ndarray, how: Structure, rng: np.random.Generator) -> np.ndarray:
    """Patches at random: their number is Poisson (one at least), their strengths exponential, their widths share what one peak would take."""
    n = max(1, int(rng.poisson(how.patches)))
    return sum((gaussian(x, at, how.width / n, strength) for at, strength in zip(rng.random(n), rng.exponential(1.0, n) + 0.1)), np.zeros(len(x)))


SHAPES = {
    "flat": lambda x, how, rng: np.ones(len(x)),
    "power_law": lambda x, how, rng: np.ones(len(x)),
    "smooth_envelope": _envelope,
    "gaussian": _peak,
    "polynomial_peaks": _polynomial,
    "scintillation": _scintillation,
    "gaussian_blobs": _patches,
}
KINDS = (*SHAPES, "random")


def spectral_structure(freqs: np.ndarray, kind: str = "scintillation", index: float = -2.0, seed: int | None = None, how: Structure = Structure()) -> np.ndarray:
    """A gain for each channel, none negative and 1 on average: a shape over the band times a power law of the frequency. ``random`` draws one of the shapes."""
    if kind not in KINDS:
        raise ValueError(f"unknown structure {kind!r}")
    rng, freqs = np.random.default_rng(seed), np.asarray(freqs, float)
    shape = SHAPES[kind if kind != "random" else list(SHAPES)[int(rng.integers(len(SHAPES)))]]
    power = shape((freqs - freqs.min()) / (np.ptp(freqs) or 1.0), how, rng) * (freqs / freqs.mean()) ** index
    total = power.sum()
    return power * len(power) / total if total > 0 else np.ones(len(power))


@dataclass(frozen=True)
class PulseParams:
    dm: float
    snr: float = 10.0
    width_ms: float = 2.0
    tau_ms: float = 0.0
    tau_ref: float = 1000.0
    tau_index: float = -4.0
    shape: str = "gaussian"
    structure: str = "flat"
    index: float = 0.0
    seed: int = 0
    oversample: int = 1


def ism(pulse: np.ndarray, gain: float, smear: float, tau: float) -> np.ndarray:
    """One channel's pulse after smearing over ``smear`` samples and scattering with an e-folding of ``tau`` samples."""
    x = pulse * gain
    w = max(1, round(smear))
    if w > 1:
        x = np.convolve(x, np.ones(w) / w, "same")
    if tau > 0:
        k = np.exp(-np.arange(min(len(x), int(np.ceil(10 * tau)) + 1)) / tau)
        x = np.convolve(x, k / k.sum())[: len(x)]
    return x


def burst(spark: SparkSession, header: ObsHeader, params: PulseParams, nsamples: int) -> DataFrame:
    """``fb`` of a noiseless burst in the middle of ``nsamples`` samples, scaled so that its band sum has the signal-to-noise ratio asked for
    in noise of unit deviation a channel. Pulses are made at ``oversample`` points a sample, moved there and averaged to samples."""
    fine = header.updated(tsamp=header.tsamp / params.oversample)
    freqs, each = header.chan_freqs, params.oversample
    width = max(1e-6, params.width_ms / 1000 / fine.tsamp)
    span = int(2 * np.ceil(4 * width) + 20 * max(0.0, params.tau_ms) / 1000 / fine.tsamp) + 65
    x = np.arange(span)
    pulse = gaussian(x, span // 3, width) if params.shape == "gaussian" else (np.abs(x - span // 3) <= width / 2).astype(float)
    gains = spectral_structure(freqs, params.structure, params.index, params.seed)
    smear = fine.smearing(params.dm)
    taus = params.tau_ms / 1000 / fine.tsamp * (freqs / params.tau_ref) ** params.tau_index if params.tau_ms > 0 else np.zeros(len(freqs))
    delays = fine.delays(params.dm)
    start = nsamples // 2 * each - span // 3
    # The profile that all channels make sets the scale; a channel's noise is 1, the band's the root of the channels.
    profile = sum(ism(pulse, g, s, t) for g, s, t in zip(gains, smear, taus))
    profile = np.bincount((start + x) // each - start // each, profile) / each
    scale = params.snr * np.sqrt(header.nchans) / np.sqrt((profile * profile).sum())
    table = spark.createDataFrame([(i, float(g), float(s), float(t), int(d)) for i, (g, s, t, d) in enumerate(zip(gains, smear, taus, delays))], "c int, gain double, smear double, tau double, delay int")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                at = (start + r.delay + x) // each
                made = np.bincount(at - at[0], ism(pulse, r.gain, r.smear, r.tau) * scale) / each
                t = at[0] + np.arange(len(made))
                ok = (t >= 0) & (t < nsamples)
                yield pd.DataFrame({"t": t[ok], "c": r.c, "v": made[ok]})

    cells = table.mapInPandas(run, "t long, c int, v double")
    grid = spark.range(nsamples).select(F.col("id").alias("t")).crossJoin(F.broadcast(table.select("c")))
    return grid.join(cells, ["t", "c"], "left").select(F.lit("burst").alias("obs_id"), "t", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def disperse(fb: DataFrame, shifts: list[int], nsamples: int, factor: int = 1) -> DataFrame:
    """Channels placed around the middle of ``nsamples`` samples, each moved by its shift; zero elsewhere. Then each ``factor`` samples become their mean."""
    spark = fb.sparkSession
    ends = fb.groupBy("obs_id").agg(F.max("t").alias("last"))
    moved = fb.join(F.broadcast(ends), "obs_id").withColumn("t", F.col("t") + F.floor((F.lit(nsamples) - F.col("last") - 1) / 2) + F.array(*[F.lit(int(s)) for s in shifts])[F.col("c")]).drop("last")
    grid = ends.select("obs_id").crossJoin(F.broadcast(spark.range(len(shifts)).select(F.col("id").cast("int").alias("c")))).crossJoin(spark.range(nsamples).select(F.col("id").alias("t")))
    out = grid.join(moved, ["obs_id", "t", "c"], "left").select("obs_id", "t", "c", F.coalesce("v", F.lit(0.0)).alias("v"))
    if factor == 1:
        return out
    return out.where(F.col("t") < nsamples // factor * factor).groupBy("obs_id", F.floor(F.col("t") / factor).alias("t"), "c").agg(F.avg("v").alias("v"))


def pulse_stats(profile: DataFrame, nsamples: int) -> DataFrame:
    """Peak, total, equivalent width (total over peak) and the length of the profile as a vector."""
    return profile.groupBy("obs_id").agg(F.max("v").alias("peak"), F.sum("v").alias("total"), (F.sum("v") / F.max("v")).alias("eq_width"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def burst_stats(profile: DataFrame, header: ObsHeader, params: PulseParams, nsamples: int, noise: float = 1.0) -> DataFrame:
    """``pulse_stats`` and what searches would find in noise of deviation ``noise`` a channel: width and signal-to-noise ratio of the best boxcar and the best Gaussian,
    the ratio of a template that is the pulse itself, and the width that pulse, sampling, scattering and smearing make together (seconds)."""
    level, widest = noise * header.nchans**0.5, nsamples // 4
    box = matched.best_pulse(matched.boxcar_snr(profile, nsamples, widest, 1.2, "norm", "norm")).select("obs_id", F.col("width").cast("double").alias("box_width"), (F.col("snr") / level).alias("box_snr"))
    peak = matched.best_pulse(matched.matched_filter(profile, "gaussian", widest, 1.2, "norm", "norm")).select("obs_id", F.col("width").alias("gauss_width"), (F.col("snr") / level).alias("gauss_snr"))
    smear = float(header.smearing(params.dm, in_samples=False).max())
    whole = float(np.sqrt((params.tau_ms / 1000) ** 2 + header.tsamp**2 + (params.width_ms / 1000) ** 2 + smear**2))
    return pulse_stats(profile, nsamples).join(box, "obs_id").join(peak, "obs_id").withColumn("template_snr", F.col("norm") / level).withColumn("eff_width", F.lit(whole))
