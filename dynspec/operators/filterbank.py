"""Operators on spectra and their cells.

Those marked row-local work within one sample and need no shuffle. Shifts by dispersion are expressed on runs of channels that share a delay: a
sample gives one partial sum for each run, and the partial sums of neighbouring samples are combined before the shuffle,
so it carries about one row per output sample and task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import LIGHT_SPEED, ObsHeader


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _sum_of(spec: str) -> Column:
    return F.expr(f"aggregate({spec}, 0D, (s, x) -> s + x)")


def collapse(spectra: DataFrame, method: str = "sum") -> DataFrame:
    """Row-local: the sum or mean over channels, as a series."""
    _check(method in ("sum", "mean"), "method must be sum or mean")
    total = _sum_of("spec")
    return spectra.select("obs_id", "t", (total if method == "sum" else total / F.size("spec")).alias("v"))


def bandpass(fb: DataFrame, method: str = "sum") -> DataFrame:
    """The sum or mean over time of each channel."""
    _check(method in ("sum", "mean"), "method must be sum or mean")
    return fb.groupBy("obs_id", "c").agg((F.sum("v") if method == "sum" else F.avg("v")).alias("v"))


def read_chan(spectra: DataFrame, header: ObsHeader, chan: int) -> DataFrame:
    """Row-local: one channel as a series."""
    _check(0 <= chan < header.nchans, f"channel {chan} out of range")
    return spectra.select("obs_id", "t", F.col("spec")[chan].alias("v"))


def block_header(header: ObsHeader, start: int, nsamps: int, fch1: float | None = None, nchans: int | None = None) -> tuple[int, int, ObsHeader]:
    """First channel, number of channels and header of a rectangle of samples and channels."""
    first = 0 if fch1 is None else round((fch1 - header.fch1) / header.foff)
    count = header.nchans - first if nchans is None else nchans
    _check(0 <= start and nsamps >= 0 and start + nsamps <= header.nsamples, "samples out of range")
    _check(0 <= first and count > 0 and first + count <= header.nchans, "channels out of range")
    return first, count, header.updated(tstart=header.mjd_after(start), nsamples=nsamps, fch1=header.fch1 + first * header.foff, nchans=count)


def read_block(spectra: DataFrame, header: ObsHeader, start: int, nsamps: int, fch1: float | None = None, nchans: int | None = None) -> tuple[DataFrame, ObsHeader]:
    """Row-local: a rectangle of samples and channels, with its header."""
    first, count, cut = block_header(header, start, nsamps, fch1, nchans)
    inside = spectra.where(F.col("t").between(start, start + nsamps - 1))
    return inside.select("obs_id", (F.col("t") - start).alias("t"), F.slice("spec", first + 1, count).alias("spec")), cut


def gulps(spectra: DataFrame, header: ObsHeader, gulp: int = 16384, start: int = 0, nsamps: int | None = None, skipback: int = 0) -> DataFrame:
    """Row-local: ``(obs_id, gulp, i, t, spec)``, the samples in windows of ``gulp`` of which each repeats the last ``skipback`` of the one before; the last may be short. For work that needs
    neighbours within a task; scans that do not need none of this."""
    count = header.nsamples - start if nsamps is None else nsamps
    _check(0 <= skipback < gulp, "the gulp must be longer than what it repeats")
    _check(0 <= start and 0 <= count and start + count <= header.nsamples, "samples out of range")
    step, at = gulp - skipback, F.col("t") - start
    last = max(0, -(-(count - skipback) // step) - 1)
    low, high = F.greatest(F.lit(0), F.floor((at - gulp) / step) + 1), F.least(F.lit(last), F.floor(at / step))
    inside = spectra.where(F.col("t").between(start, start + count - 1)).select("obs_id", "t", "spec", F.explode(F.sequence(low, high)).alias("gulp"))
    return inside.select("obs_id", F.col("gulp").cast("int").alias("gulp"), (F.col("t") - start - F.col("gulp") * step).cast("int").alias("i"), "t", "spec")


def extract_samples(spectra: DataFrame, header: ObsHeader, start: int, nsamps: int) -> tuple[DataFrame, ObsHeader]:
    return read_block(spectra, header, start, nsamps)


def extract_chans(spectra: DataFrame, header: ObsHeader, chans: Sequence[int] | None = None) -> DataFrame:
    """Row-local: ``(obs_id, c, t, v)`` of the channels asked for; write it partitioned by ``c`` for a file per channel."""
    wanted = list(range(header.nchans)) if chans is None else sorted(set(chans))
    _check(all(0 <= c < header.nchans for c in wanted), "channels out of range")
    return spectra.select("obs_id", "t", F.posexplode("spec").alias("c", "v")).where(F.col("c").isin(wanted)).select("obs_id", "c", "t", "v")


def extract_bands(spectra: DataFrame, header: ObsHeader, chanstart: int, nchans: int, chanpersub: int | None = None) -> DataFrame:
    """Row-local: ``(obs_id, band, t, spec)``, each band ``chanpersub`` channels."""
    per = nchans if chanpersub is None else chanpersub
    _check(per > 1 and nchans % per == 0, "a band needs over one channel and must divide the channels")
    _check(0 <= chanstart and chanstart + nchans <= header.nchans, "channels out of range")
    bands = F.array(*[F.slice("spec", chanstart + i * per + 1, per) for i in range(nchans // per)])
    return spectra.select("obs_id", "t", F.posexplode(bands).alias("band", "spec")).select("obs_id", "band", "t", "spec")


def invert_freq(spectra: DataFrame, header: ObsHeader) -> tuple[DataFrame, ObsHeader]:
    """Row-local: channels in reverse order."""
    return spectra.withColumn("spec", F.reverse("spec")), header.updated(fch1=header.fch1 + (header.nchans - 1) * header.foff, foff=-header.foff)


def apply_channel_mask(spectra: DataFrame, masked: Sequence[bool], value: float = 0.0) -> DataFrame:
    """Row-local: masked channels get ``value``. The mask has one flag per channel."""
    flags = F.array(*[F.lit(bool(m)) for m in masked])
    return spectra.withColumn("spec", F.zip_with("spec", flags, lambda v, m: F.when(m, F.lit(float(value))).otherwise(v)))


def apply_mask_table(fb: DataFrame, mask: DataFrame, value: float = 0.0) -> DataFrame:
    """The same with a table ``mask(c, masked)``; it has a row per channel, so it is broadcast."""
    return fb.join(F.broadcast(mask.select("c", "masked")), "c", "left").select("obs_id", "t", "c", F.when(F.coalesce("masked", F.lit(False)), F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def channel_stats(fb: DataFrame, mode: str = "full") -> DataFrame:
    """Moments, least and greatest value of each channel; a channel that does not vary has skew 0 and kurtosis -3."""
    _check(mode in ("full", "basic"), "mode must be full or basic")
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")]
    if mode == "full":
        aggs += [F.coalesce(F.nanvl(F.skewness("v"), F.lit(0.0)), F.lit(0.0)).alias("skew"), F.coalesce(F.nanvl(F.kurtosis("v"), F.lit(-3.0)), F.lit(-3.0)).alias("kurt")]
    return fb.groupBy("obs_id", "c").agg(*aggs, F.min("v").alias("min"), F.max("v").alias("max"))


def partial_stats(fb: DataFrame, *keys: str) -> DataFrame:
    """Mergeable statistics of each channel (and of ``keys``): combine them with ``merge_stats``. Moments are about a part's own mean, so that large means cancel nothing."""
    made = channel_stats(fb.withColumn("c", F.struct(*keys, "c")) if keys else fb)
    spread = F.col("n") * F.col("var")
    return made.select("obs_id", *[F.col(f"c.{k}").alias(k) for k in keys], (F.col("c.c") if keys else F.col("c")).alias("c"), "n", "mean", spread.alias("m2"), (F.col("skew") * spread * F.sqrt("var")).alias("m3"), ((F.col("kurt") + 3) * spread * F.col("var")).alias("m4"), "min", "max")


def merge_stats(partials: DataFrame) -> DataFrame:
    """Channel statistics of any number of partial ones."""
    whole = partials.groupBy("obs_id", "c").agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))
    d, n, m2, m3 = F.col("mean") - F.col("centre"), F.col("n"), F.col("m2"), F.col("m3")
    moved = {"m2": m2 + n * d * d, "m3": m3 + 3 * d * m2 + n * d * d * d, "m4": F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d}
    s = partials.join(whole, ["obs_id", "c"]).groupBy("obs_id", "c").agg(F.max("total").alias("n"), F.max("centre").alias("mean"), *[F.sum(x).alias(k) for k, x in moved.items()], F.min("min").alias("min"), F.max("max").alias("max"))
    var, flat = F.col("m2") / F.col("n"), F.col("m2") <= 0
    return s.select("obs_id", "c", "n", "mean", var.alias("var"), F.when(flat, 0.0).otherwise(F.col("m3") / F.col("n") / F.pow(var, F.lit(1.5))).alias("skew"), F.when(flat, -3.0).otherwise(F.col("m4") / F.col("n") / (var * var) - 3).alias("kurt"), "min", "max")


def _runs(delays: np.ndarray, cuts: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """``(cut, delay, first channel, channels)`` of each run of channels with one delay (and one cut)."""
    cuts = np.zeros(len(delays), int) if cuts is None else cuts
    edges = [0, *(np.flatnonzero((np.diff(delays) != 0) | (np.diff(cuts) != 0)) + 1).tolist(), len(delays)]
    return [(int(cuts[a]), int(delays[a]), a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _parts(spectra: DataFrame, runs: list[tuple[int, int, int, int]], cut: str) -> DataFrame:
    """A partial sum of each run, at the sample it belongs to."""
    table = "array(" + ", ".join(f"struct({a} AS k, {d} AS d, {c + 1} AS first, {n} AS n)" for a, d, c, n in runs) + ")"
    made = f"transform({table}, r -> struct(r.k AS {cut}, t - r.d AS t, aggregate(slice(spec, r.first, r.n), 0D, (s, x) -> s + x) AS v))"
    return spectra.select("obs_id", F.expr(f"inline({made})"))


def valid_range(delays: np.ndarray, nsamples: int) -> tuple[int, int]:
    """First and last-but-one sample for which every delayed sample exists."""
    low, high = max(0, -int(delays.min())), nsamples - max(0, int(delays.max()))
    _check(low < high, "not enough samples for these delays")
    return low, high


def dedisperse(spectra: DataFrame, header: ObsHeader, dm: float, ref: str | float = "fch1") -> DataFrame:
    """The sum over channels at their delays, as a series."""
    d = header.delays(dm, ref)
    low, high = valid_range(d, header.nsamples)
    parts = _parts(spectra, _runs(d), "k").where(F.col("t").between(low, high - 1))
    return parts.groupBy("obs_id", "t").agg(F.sum("v").alias("v"))


def subband(spectra: DataFrame, header: ObsHeader, dm: float, nsub: int, ref: str | float = "fch1") -> tuple[DataFrame, ObsHeader]:
    """``(obs_id, t, c, v)``: dedispersed sums of ``nsub`` bands."""
    _check(0 < nsub <= header.nchans and header.nchans % nsub == 0, "bands must divide the channels")
    d, per = header.delays(dm, ref), header.nchans // nsub
    low, high = valid_range(d, header.nsamples)
    parts = _parts(spectra, _runs(d, np.arange(header.nchans) // per), "c").where(F.col("t").between(low, high - 1))
    made = parts.groupBy("obs_id", "t", "c").agg(F.sum("v").alias("v"))
    return made, header.updated(nchans=nsub, foff=header.foff * per, fch1=header.ftop + header.foff * per / 2, dm=dm, nsamples=high - low)


def dmt_transform(spectra: DataFrame, header: ObsHeader, dms: Sequence[float], ref: str | float = "fch1", valid_only: bool = False) -> DataFrame:
    """``dmt(obs_id, dm, t, v)``: a dedispersed series for each DM; circular, or where all DMs are valid."""
    every = header.delays(np.asarray(dms, float), ref)
    runs = [(i, d, c, n) for i, row in enumerate(every) for _, d, c, n in _runs(row)]
    parts = _parts(spectra, runs, "i")
    if valid_only:
        low, high = valid_range(every, header.nsamples)
        parts = parts.where(F.col("t").between(low, high - 1))
    else:
        parts = parts.withColumn("t", F.pmod("t", F.lit(header.nsamples)))
    names = F.array(*[F.lit(float(x)) for x in dms])
    return parts.groupBy("obs_id", "i", "t").agg(F.sum("v").alias("v")).select("obs_id", names[F.col("i")].alias("dm"), "t", "v")


def dm_grid(dm: float, steps: int = 512) -> list[float]:
    """Trial DMs from 0 to twice ``dm``."""
    return np.linspace(0, 2 * dm, steps).tolist()


def dedisperse_block(fb: DataFrame, header: ObsHeader, dm: float, ref: str | float = "fch1", valid_only: bool = False) -> DataFrame:
    """Every channel shifted by its delay; circular, or where all channels are valid. No shuffle."""
    d = header.delays(dm, ref)
    shift = F.array(*[F.lit(int(x)) for x in d])[F.col("c")]
    moved = fb.withColumn("t", F.col("t") - shift)
    if valid_only:
        low, high = valid_range(d, header.nsamples)
        return moved.where(F.col("t").between(low, high - 1))
    return moved.withColumn("t", F.pmod("t", F.lit(header.nsamples)))


def read_dedisp_block(fb: DataFrame, header: ObsHeader, start: int, nsamps: int, dm: float) -> DataFrame:
    """Samples ``start`` on of the dedispersed block, numbered from 0; all of them must exist."""
    d = header.delays(dm)
    _check(start + int(d.min()) >= 0 and start + nsamps + int(d.max()) <= header.nsamples, "samples out of range at this DM")
    shift = F.array(*[F.lit(int(x)) for x in d])[F.col("c")]
    return fb.withColumn("t", F.col("t") - shift - start).where(F.col("t").between(0, nsamps - 1))


def roll(fb: DataFrame, shifts: Sequence[int], nsamples: int, valid_only: bool = False) -> DataFrame:
    """Each channel moved later by its shift."""
    moved = fb.withColumn("t", F.col("t") + F.array(*[F.lit(int(s)) for s in shifts])[F.col("c")])
    if valid_only:
        return moved.where(F.col("t").between(max(0, *shifts), nsamples + min(0, *shifts) - 1))
    return moved.withColumn("t", F.pmod("t", F.lit(nsamples)))


def downsample(fb: DataFrame, header: ObsHeader, tfactor: int = 1, ffactor: int = 1, method: str = "mean") -> tuple[DataFrame, ObsHeader]:
    """The mean or median of tiles; what does not fill a tile in time is dropped."""
    _check(tfactor > 0 and ffactor > 0 and header.nchans % ffactor == 0, "factors must be positive and divide the channels")
    _check(method in ("mean", "median"), "method must be mean or median")
    whole = header.nsamples // tfactor
    tiles = fb.where(F.col("t") < whole * tfactor).groupBy("obs_id", F.floor(F.col("t") / tfactor).alias("t"), F.floor(F.col("c") / ffactor).cast("int").alias("c"))
    made = tiles.agg((F.avg("v") if method == "mean" else F.median("v")).alias("v"))
    return made, header.updated(tsamp=header.tsamp * tfactor, foff=header.foff * ffactor, fch1=header.ftop + header.foff * ffactor / 2, nchans=header.nchans // ffactor, nsamples=whole)


def remove_zerodm(fb: DataFrame) -> DataFrame:
    """Each sample less the channel's share of the sample's sum, plus the channel's mean."""
    band = bandpass(fb, "mean").withColumnRenamed("v", "bp")
    band = band.withColumn("share", F.try_divide(F.col("bp"), F.sum("bp").over(W.partitionBy("obs_id"))))
    total = fb.groupBy("obs_id", "t").agg(F.sum("v").alias("total"))
    met = fb.join(F.broadcast(band), ["obs_id", "c"]).join(total, ["obs_id", "t"])
    return met.select("obs_id", "t", "c", (F.col("v") - F.col("total") * F.col("share") + F.col("bp")).alias("v"))


def requantize(fb: DataFrame, nbits: int) -> DataFrame:
    """Each channel normalised and turned to levels of ``nbits`` bits."""
    from ..functions.columns import quantized

    stats = fb.groupBy("obs_id", "c").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return fb.join(F.broadcast(stats), ["obs_id", "c"]).select("obs_id", "t", "c", quantized(z, nbits).alias("v"))


def fold_keys(header: ObsHeader, period: float, accel: float, nbins: int, nints: int) -> tuple[Column, Column]:
    """Phase bin and subintegration of sample ``t``."""
    tj = F.col("t") * F.lit(header.tsamp)
    phase = F.lit(float(nbins)) * tj * (F.lit(1.0) + F.lit(accel) * (tj - F.lit(header.tobs)) / F.lit(2 * LIGHT_SPEED)) / F.lit(period) + F.lit(0.5)
    return (F.abs(phase.cast("long")) % nbins).cast("int"), F.floor(F.col("t") / F.lit(header.nsamples / nints)).cast("int")


def fold(spectra: DataFrame, header: ObsHeader, period: float, dm: float, accel: float = 0.0, nbins: int = 50, nints: int = 32, nbands: int = 32, ref: str | float = "fch1") -> DataFrame:
    """``cube``: the mean of the dedispersed samples of each subintegration, band and phase bin; an empty cell is null with ``n`` 0."""
    nbands = min(nbands, header.nchans)
    _check(header.nsamples * header.nchans // (nbands * nints * nbins) >= 10, "too few samples for a cube of this size")
    d = header.delays(dm, ref)
    low, high = valid_range(d, header.nsamples)
    bands = np.minimum((np.arange(header.nchans) / (header.nchans / nbands)).astype(int), nbands - 1)
    runs = _runs(d, bands)
    table = "array(" + ", ".join(f"struct({a} AS band, {dd} AS d, {c + 1} AS first, {n} AS n)" for a, dd, c, n in runs) + ")"
    made = f"transform({table}, r -> struct(r.band, t - r.d AS t, aggregate(slice(spec, r.first, r.n), 0D, (s, x) -> s + x) AS v, r.n AS n))"
    parts = spectra.select("obs_id", F.expr(f"inline({made})")).where(F.col("t").between(low, high - 1))
    phase, subint = fold_keys(header, period, accel, nbins, nints)
    cells = parts.groupBy("obs_id", subint.alias("subint"), "band", phase.alias("bin")).agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").cast("long").alias("n"))
    spark = spectra.sparkSession
    axis = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    grid = cells.select("obs_id").distinct().crossJoin(F.broadcast(axis(nints, "subint").crossJoin(axis(nbands, "band")).crossJoin(axis(nbins, "bin"))))
    return grid.join(cells, ["obs_id", "subint", "band", "bin"], "left").select("obs_id", "subint", "band", "bin", "v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pad_samples(fb: DataFrame, nsamples: int, total: int, offset: int, method: str = "median") -> DataFrame:
    """The block from sample ``offset`` on among ``total``; the others get the median or mean of their channel."""
    from . import series

    _check(method in ("median", "mean"), "method must be median or mean")
    return series.pad(fb, nsamples, total, method, offset, ("c",))
