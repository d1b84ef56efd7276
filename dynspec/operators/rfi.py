"""Interference: masks of channels from their statistics, and cleaning by them. A mask has one row per channel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import ObsHeader
from .filterbank import apply_mask_table, channel_stats
from .robust import zscore


def double_mad_mask(values: DataFrame, by: Sequence[str] = ("obs_id",), value: str = "v", threshold: float = 3.0) -> DataFrame:
    """``values`` with ``masked``: further than the threshold from the median, each side by its own deviation."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    return zscore(values, by, "median", "doublemad", value).withColumn("masked", F.abs("z") > threshold).drop("z", "loc", "scale")


def iqrm_mask(values: DataFrame, by: Sequence[str] = ("obs_id",), value: str = "v", threshold: float = 3.0, radius: int = 5) -> DataFrame:
    """``values`` with ``masked``: an outlying difference to a neighbour at any lag up to ``radius``; ends repeat."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    by = list(by)
    w = W.partitionBy(*by).orderBy("c")
    first, last = F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    lags = [x for x in range(-radius, radius + 1) if x]
    near = [F.struct(F.lit(x).alias("lag"), (F.col(value) - (F.coalesce(F.lag(value, x).over(w), first) if x > 0 else F.coalesce(F.lead(value, -x).over(w), last))).alias("d")) for x in lags]
    diffs = values.select("*", F.array(*near).alias("_n")).select(*by, "c", F.explode("_n").alias("_x")).select(*by, "c", "_x.lag", "_x.d")
    z = zscore(diffs, [*by, "lag"], "median", "iqr", "d")
    flags = z.groupBy(*by, "c").agg(F.bool_or(F.abs("z") > threshold).alias("masked"))
    return values.join(flags, [*by, "c"])


def frequency_mask(channels: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """``channels(c, freq)`` with ``user``: inside any of the ranges, ends included."""
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("freq").between(low, high)
    return channels.withColumn("user", inside)


def channels(spark, header: ObsHeader) -> DataFrame:
    """``(c, freq)``."""
    return spark.range(header.nchans).select(F.col("id").cast("int").alias("c"), (F.col("id") * header.foff + header.fch1).alias("freq"))


def rfi_mask(fb: DataFrame, header: ObsHeader, method: str = "mad", threshold: float = 3.0, freq_ranges: Sequence[tuple[float, float]] = (), custom: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``mask``: statistics of each channel, what each rule says of it, and ``masked``.

    Variance, skewness and kurtosis are judged by ``mad`` or ``iqrm``. ``custom`` gets the mask so far as booleans by channel and
    returns more; a mask has one value a channel, so it runs on the driver.
    """
    if method not in ("mad", "iqrm"):
        raise ValueError("method must be mad or iqrm")
    # A row a channel, which every rule reads several times: made once, and again only where an executor is lost.
    stats = channel_stats(fb).persist()
    judge = double_mad_mask if method == "mad" else iqrm_mask
    out = stats.join(F.broadcast(frequency_mask(channels(fb.sparkSession, header), freq_ranges)), "c")
    # All three statistics are judged in one pass, each a group of its own.
    each = stats.select("obs_id", "c", F.expr("stack(3, 'var', var, 'skew', skew, 'kurt', kurt) AS (name, x)"))
    flags = judge(each, ("obs_id", "name"), "x", threshold).groupBy("obs_id", "c").agg(F.bool_or("masked").alias("stats"))
    out = out.join(F.broadcast(flags), ["obs_id", "c"])
    if custom is None:
        return out.withColumn("custom", F.lit(False)).withColumn("masked", F.col("user") | F.col("stats"))
    so_far = [r.m for r in out.groupBy("c").agg(F.bool_or(F.col("user") | F.col("stats")).alias("m")).orderBy("c").collect()]
    more = F.array(*[F.lit(bool(x)) for x in custom(np.array(so_far))])
    return out.withColumn("custom", more[F.col("c")]).withColumn("masked", F.col("user") | F.col("stats") | F.col("custom"))


def masked_fraction(mask: DataFrame) -> DataFrame:
    """Masked channels of each record, and their share in per cent."""
    return mask.groupBy("obs_id").agg(F.count_if("masked").alias("num_masked"), (100.0 * F.count_if("masked") / F.count("*")).alias("masked_fraction"))


def clean(fb: DataFrame, header: ObsHeader, method: str = "mad", threshold: float = 3.0, freq_ranges: Sequence[tuple[float, float]] = (), custom: Callable[[np.ndarray], np.ndarray] | None = None, value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The cells with masked channels replaced (by default with the median of the other channels' means), and the mask."""
    mask = rfi_mask(fb, header, method, threshold, freq_ranges, custom)
    if value is not None:
        return apply_mask_table(fb, mask, value), mask
    level = mask.groupBy("obs_id").agg(F.coalesce(F.median(F.when(~F.col("masked"), F.col("mean"))), F.lit(0.0)).alias("level"))
    met = fb.join(F.broadcast(mask.select("obs_id", "c", "masked").join(level, "obs_id")), ["obs_id", "c"])
    return met.select("obs_id", "t", "c", F.when(F.col("masked"), F.col("level")).otherwise(F.col("v")).alias("v")), mask
