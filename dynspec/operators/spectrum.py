"""Operators on Fourier series and spectra."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import amplitude, complex_product
from ..meta import ObsHeader
from .series import lagged


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two Fourier series, bin by bin."""
    met = a.alias("a").join(b.alias("b"), ["obs_id", "k"])
    re, im = complex_product(F.col("a.re"), F.col("a.im"), F.col("b.re"), F.col("b.im"))
    return met.select("obs_id", "k", re.alias("re"), im.alias("im"))


def form_spec(fseries: DataFrame, interpolate: bool = False) -> DataFrame:
    """``spectrum`` of amplitudes; interpolated: the greater of a bin's own and half the power between it and the last."""
    if not interpolate:
        return fseries.select("obs_id", F.lit(0).alias("nfold"), "k", amplitude(F.col("re"), F.col("im")).alias("p"))
    fseries = lagged(fseries, "k", ["re", "im"], F.lit(0.0))
    dr, di = F.col("re") - F.col("last_re"), F.col("im") - F.col("last_im")
    power = F.greatest(F.col("re") * F.col("re") + F.col("im") * F.col("im"), (dr * dr + di * di) / 2)
    return fseries.select("obs_id", F.lit(0).alias("nfold"), "k", F.sqrt(power).alias("p"))


def ifft(fseries: DataFrame, size: int | None = None, transform: Callable[..., np.ndarray] = np.fft.irfft) -> DataFrame:
    """The series of a Fourier series; ``size`` tells odd lengths from even ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = transform(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), size or 2 * (len(pdf) - 1))
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "t": np.arange(len(x)), "v": x})

    return fseries.groupBy("obs_id").applyInPandas(run, "obs_id string, t long, v double")


def harmonic_terms(bins: int, fold: int) -> list[tuple[int, int]]:
    """``(i, j)``: bin j is added to bin i when the sums go from ``2 ** fold`` to twice as many harmonics."""
    nh = 2 ** (fold + 1)
    blocks = len(range(1, bins - (nh - 1), nh))
    return [(b * nh + h + 1, (k + nh // 2) // nh + k * b + k * h // nh) for b in range(blocks) for h in range(nh) for k in range(1, nh, 2)]


def harmonic_fold(spectrum: DataFrame, bins: int, nfolds: int = 1) -> DataFrame:
    """``spectrum`` with sums of 2, 4, 8 ... harmonics as ``nfold`` 1, 2, 3 ...

    Which bins add up follows from the bin's number, so a fold is an equi-join on computed numbers.
    """
    out = now = spectrum.where(F.col("nfold") == 0)
    for fold in range(nfolds):
        nh = 2 ** (fold + 1)
        last = len(range(1, bins - (nh - 1), nh)) * nh
        odd = F.array(*[F.lit(k) for k in range(1, nh, 2)])
        asked = now.where(F.col("k").between(1, last)).select("obs_id", F.col("k").alias("i"), F.explode(odd).alias("m"))
        b, h = F.floor((F.col("i") - 1) / nh), (F.col("i") - 1) % nh
        place = F.floor((F.col("m") + nh // 2) / nh) + F.col("m") * b + F.floor(F.col("m") * h / nh)
        base = spectrum.where(F.col("nfold") == 0).select("obs_id", F.col("k").alias("j"), F.col("p").alias("q"))
        more = asked.withColumn("j", place.cast("long")).join(base, ["obs_id", "j"]).groupBy("obs_id", F.col("i").alias("k")).agg(F.sum("q").alias("q"))
        now = now.join(more, ["obs_id", "k"], "left").select("obs_id", F.lit(fold + 1).alias("nfold"), "k", (F.col("p") + F.coalesce("q", F.lit(0.0))).alias("p"))
        out = out.unionByName(now)
    return out


def deredden_blocks(bins: int, tobs: float, start_width: int = 6, end_width: int = 100, end_freq: float = 6.0) -> list[tuple[int, int]]:
    """First bin and number of bins of each block: widths grow with the logarithm of the bin up to ``end_freq``, and are level from there."""
    out, at, width = [], 1, start_width
    while at < bins:
        width = min(width, bins - at)
        out.append((at, width))
        at += width
        # The second block's width is logarithmic in any case.
        width = max(1, round(start_width * np.log(at))) if len(out) == 1 or at < round(end_freq * tobs) else end_width
    return out


def deredden(fseries: DataFrame, header: ObsHeader, bins: int, start_width: int = 6, end_width: int = 100, end_freq: float = 6.0) -> DataFrame:
    """Bins over the root of the local mean power, which is the median of blocks over ln 2, interpolated between blocks.

    The blocks follow from lengths alone, so they are a small table, and the medians an ordinary aggregate.
    """
    blocks = deredden_blocks(bins, header.tobs, start_width, end_width, end_freq)
    spark = fseries.sparkSession
    table = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(blocks)], "b int, first long, n long")
    spots = F.broadcast(table.select("b", "first", "n", F.explode(F.sequence("first", F.expr("first + n - 1"))).alias("k")))
    rows = fseries.join(spots, "k").withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    means = rows.groupBy("obs_id", "b").agg((F.median("power") / float(np.log(2))).alias("m"), F.first("n").alias("n"))
    w = W.partitionBy("obs_id").orderBy("b")
    pairs = means.select("obs_id", "b", F.col("m").alias("m0"), F.col("n").alias("n0"), F.lead("m").over(w).alias("m1"), F.lead("n").over(w).alias("n1"))
    met = rows.drop("n").join(pairs, ["obs_id", "b"])
    i, both = F.col("k") - F.col("first"), F.col("n0") + F.col("n1")
    level = F.col("m0") + F.coalesce((F.col("m1") - F.col("m0")) / both * (both / 2 - i) * F.lit(1.0), F.lit(0.0))
    norm = 1 / F.sqrt(level)
    zero = fseries.where("k = 0").select("obs_id", "k", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return met.select("obs_id", "k", (F.col("re") * norm).alias("re"), (F.col("im") * norm).alias("im")).unionByName(zero)


def recon_prof(fseries: DataFrame, header: ObsHeader, freq: float, nharms: int = 32) -> DataFrame:
    """``(obs_id, bin, v)``: the profile that the harmonics of a frequency make."""
    places = [round(freq * header.tobs * h) for h in range(1, nharms + 1)]
    picked = fseries.where(F.col("k").isin(places))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(pdf["k"], pdf["re"] + 1j * pdf["im"]))
        harms = np.array([at.get(p, 0) for p in places])
        whole = np.concatenate([[0], harms, np.conj(harms[-2::-1])])
        prof = np.abs(np.fft.ifft(whole))
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "bin": np.arange(len(prof)), "v": prof})

    return picked.groupBy("obs_id").applyInPandas(run, "obs_id string, bin int, v double")


def top_peaks(spectrum: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest bins of each sum of harmonics."""
    w = W.partitionBy("obs_id", "nfold").orderBy(F.desc("p"), "k")
    return spectrum.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
