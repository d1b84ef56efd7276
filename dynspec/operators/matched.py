"""Matched filters: the signal-to-noise ratio of pulse templates at every place of a series, going round.

Boxcars have a closed form in frames. Other templates are correlated by transforms, a series a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import good_size, width_ladder
from .robust import zscore
from .series import framed

FWHM = 2 * np.sqrt(2 * np.log(2))


def boxcar_snr(series: DataFrame, nsamples: int, widest: int = 32, factor: float = 1.5, loc_method: str = "median", scale_method: str = "iqr") -> DataFrame:
    """``(obs_id, itemp, width, t, snr)``: a zero-mean, unit-norm boxcar starting at ``t``."""
    widths = width_ladder(min(widest, nsamples - 1), factor)
    z = zscore(series, ["obs_id"], loc_method, scale_method).select("obs_id", "t", "z")
    mean = z.groupBy("obs_id").agg(F.avg("z").alias("zm"))
    # Sums of all widths in blocks of samples: a record is not one task's.
    over = lambda w: W.partitionBy("obs_id", "b").orderBy("p").rowsBetween(0, w - 1)
    sums = framed(z.withColumnRenamed("z", "v"), nsamples, 0, widths[-1] - 1, lambda _: F.array(*[F.sum("v").over(over(w)) for w in widths]), "circular")
    sums = sums.select("obs_id", "t", *[F.col("v")[i].alias(f"s{i}") for i in range(len(widths))])
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("itemp"), F.lit(w).alias("width"), F.col(f"s{i}").alias("s")) for i, w in enumerate(widths)]))
    rows = sums.select("obs_id", "t", made.alias("x")).select("obs_id", "t", "x.*").join(F.broadcast(mean), "obs_id")
    norm = F.sqrt(F.col("width") * (1 - F.col("width") / F.lit(float(nsamples))))
    return rows.select("obs_id", "itemp", "width", "t", ((F.col("s") - F.col("width") * F.col("zm")) / norm).alias("snr"))


def best_pulse(snrs: DataFrame) -> DataFrame:
    """The best template and place of each series; ties go to the first template, then the first place."""
    w = W.partitionBy("obs_id").orderBy(F.desc("snr"), "itemp", "t")
    return snrs.withColumn("r", F.row_number().over(w)).where("r = 1").select("obs_id", F.col("itemp").cast("int").alias("itemp"), "width", F.col("t").alias("peak_bin"), "snr")


def template(kind: str, width: float, extent: float = 3.5) -> tuple[np.ndarray, int]:
    """A pulse and the place of its reference: a boxcar's start, a peak's middle."""
    if kind == "boxcar":
        return np.ones(int(width)), 0
    if kind == "gaussian":
        sigma = width / FWHM
        half = int(np.ceil(extent * sigma))
        x = np.arange(-half, half + 1)
        return np.exp(-(x**2) / (2 * sigma**2)), half
    if kind == "lorentzian":
        gamma = width / 2
        half = int(np.ceil(extent * width))
        x = np.arange(-half, half + 1)
        return gamma**2 / (x**2 + gamma**2), half
    raise ValueError(f"unknown template {kind!r}")


def normalise_template(x: np.ndarray) -> np.ndarray:
    """Of zero mean and unit length."""
    x = x - x.mean()
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else x


def templates(kind: str, widest: float = 32, factor: float = 1.5) -> list[tuple[float, np.ndarray, int]]:
    if kind == "boxcar":
        widths = [float(w) for w in width_ladder(int(widest), factor)]
    else:
        widths = np.geomspace(1, widest, max(1, int(np.log(widest) / np.log(factor)) + 1)).tolist()
    return [(w, *template(kind, w)) for w in widths]


def best_model(best: DataFrame, kind: str, nsamples: int) -> DataFrame:
    """``(obs_id, t, v)``: the normalised template of each row of ``best_pulse``, its reference at the peak, going round."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                shape, ref = template(kind, r.width)
                if len(shape) > nsamples:
                    raise ValueError("the template is longer than the series")
                long = np.zeros(nsamples)
                long[: len(shape)] = shape
                yield pd.DataFrame({"obs_id": r.obs_id, "t": np.arange(nsamples), "v": np.roll(normalise_template(long), r.peak_bin - ref)})

    return best.select("obs_id", "width", "peak_bin").mapInPandas(run, "obs_id string, t long, v double")


def on_pulse(best: DataFrame, kind: str, nsamples: int) -> DataFrame:
    """``best`` with ``on_start`` and ``on_end`` (exclusive): a boxcar's own samples, or a width to either side of a peak, inside the series."""
    wide = F.rint("width")
    low, high = (F.col("peak_bin"), F.col("peak_bin") + F.col("width")) if kind == "boxcar" else (F.col("peak_bin") - wide, F.col("peak_bin") + wide)
    return best.withColumn("on_start", F.greatest(F.lit(0), low).cast("long")).withColumn("on_end", F.least(F.lit(nsamples), high).cast("long"))


def convolve(z: np.ndarray, bank: list[tuple[float, np.ndarray, int]]) -> np.ndarray:
    """Templates x samples: circular correlations with each normalised template."""
    n = len(z)
    f = np.fft.rfft(z)
    out = []
    for _, shape, ref in bank:
        long = np.zeros(n)
        for i, v in enumerate(shape):
            long[(i - ref) % n] += v
        out.append(np.fft.irfft(f * np.conj(np.fft.rfft(normalise_template(long))), n))
    return np.array(out)


def matched_filter(series: DataFrame, kind: str = "gaussian", widest: float = 32, factor: float = 1.5, loc_method: str = "median", scale_method: str = "iqr") -> DataFrame:
    """``(obs_id, itemp, width, t, snr)`` with templates of any kind."""
    bank = templates(kind, widest, factor)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        made = convolve(pdf["z"].to_numpy(), [b for b in bank if len(b[1]) <= len(pdf)])
        n = len(pdf)
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "itemp": np.repeat(np.arange(len(made)), n), "width": np.repeat([b[0] for b in bank[: len(made)]], n), "t": np.tile(pdf["t"].to_numpy(), len(made)), "snr": made.ravel()})

    z = zscore(series, ["obs_id"], loc_method, scale_method).select("obs_id", "t", "z")
    return z.groupBy("obs_id").applyInPandas(run, "obs_id string, itemp int, width double, t long, snr double")


def convolve_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(obs_id, t, v)``: the full convolution of two series of a record, by transforms; a pair is one task's."""
    both = a.select("obs_id", "t", "v", F.lit(0).alias("side")).unionAll(b.select("obs_id", "t", "v", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = fftconvolve(*(pdf.loc[pdf["side"] == i, "v"].to_numpy(float) for i in (0, 1)))
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "t": np.arange(len(v)), "v": v})

    return both.groupBy("obs_id").applyInPandas(run, "obs_id string, t long, v double")


def fftconvolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The full convolution; of nothing, nothing."""
    if not len(a) or not len(b):
        return np.zeros(0)
    n = len(a) + len(b) - 1
    size = good_size(n)
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]
