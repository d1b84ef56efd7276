"""Operators on folded cubes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import ObsHeader
from . import matched


def profile(cube: DataFrame) -> DataFrame:
    return cube.groupBy("obs_id", "bin").agg(F.sum("v").alias("v"))


def time_phase(cube: DataFrame) -> DataFrame:
    return cube.groupBy("obs_id", "subint", "bin").agg(F.sum("v").alias("v"))


def freq_phase(cube: DataFrame) -> DataFrame:
    return cube.groupBy("obs_id", "band", "bin").agg(F.sum("v").alias("v"))


def marginals(cube: DataFrame) -> DataFrame:
    """All three at once, by grouping sets; the summed axes are null."""
    keys = {c: F.col(c) for c in ("obs_id", "subint", "band", "bin")}
    sets = [[keys[c] for c in kept] for kept in (("obs_id", "bin"), ("obs_id", "subint", "bin"), ("obs_id", "band", "bin"))]
    return cube.groupingSets(sets, *keys.values()).agg(F.sum("v").alias("v"))


def get_subint(cube: DataFrame, i: int) -> DataFrame:
    return cube.where(F.col("subint") == i)


def get_subband(cube: DataFrame, i: int) -> DataFrame:
    return cube.where(F.col("band") == i)


def normalise_rows(phase: DataFrame, row: str) -> DataFrame:
    """Each row over its mean."""
    return phase.withColumn("v", F.try_divide(F.col("v"), F.avg("v").over(W.partitionBy("obs_id", row))))


def replace_nan(cube: DataFrame) -> DataFrame:
    """Empty cells get the median of the others."""
    fill = cube.groupBy("obs_id").agg(F.median("v").alias("fill"))
    return cube.join(F.broadcast(fill), "obs_id").withColumn("v", F.coalesce("v", "fill")).drop("fill")


def update_dm(cube: DataFrame, header: ObsHeader, dm: float, nbands: int, nbins: int, ref: str | float = "fch1") -> DataFrame:
    """The cube as folded at another DM than the header's: each band's bins move by the difference of its delays."""
    per = header.nchans // nbands
    bands = header.updated(nchans=nbands, foff=header.foff * per, fch1=header.ftop + header.foff * per / 2, tsamp=header.period / nbins)
    shift = bands.delays(dm - header.dm, header.reference(ref))
    moved = F.array(*[F.lit(int(s)) for s in shift])[F.col("band")]
    return cube.withColumn("bin", F.pmod(F.col("bin") - moved, F.lit(nbins)))


def update_period(cube: DataFrame, header: ObsHeader, period: float, nints: int, nbins: int) -> DataFrame:
    """The cube as folded at another period: each subintegration drifts by its share of the difference."""
    total = (period / header.period - 1) * header.tobs * nbins / header.period
    drift = F.rint(F.col("subint") * F.lit(total / nints)).cast("int")
    return cube.withColumn("bin", F.pmod(F.col("bin") - drift, F.lit(nbins)))


def centre(cube: DataFrame, nbins: int) -> DataFrame:
    """The cube turned so that the middle of the pulse stands in the middle."""
    best = matched.best_pulse(matched.boxcar_snr(profile(cube).withColumnRenamed("bin", "t"), nbins, nbins // 2))
    turn = best.select("obs_id", (F.lit(nbins // 2) - (F.col("peak_bin") + F.floor(F.col("width") / 2))).cast("int").alias("turn"))
    return cube.join(F.broadcast(turn), "obs_id").withColumn("bin", F.pmod(F.col("bin") + F.col("turn"), F.lit(nbins))).drop("turn")
