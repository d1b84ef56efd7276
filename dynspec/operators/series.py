"""Operators on series: frames, reflection at the ends, downsampling, resampling, transforms.

A frame over a long series is computed in blocks of samples with the neighbours each block needs, so one record does not go to one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..meta import LIGHT_SPEED, ObsHeader, good_size

BLOCK = 1 << 16


def framed(series: DataFrame, nsamples: int, before: int, after: int, made: Callable[[W], Column], ends: str = "reflect") -> DataFrame:
    """``made`` over the frame from ``before`` samples back to ``after`` ahead; past the ends the series is reflected (the end sample repeats) or, ``circular``, goes round."""
    if max(before, after) > nsamples:
        raise ValueError("the window is longer than the series")
    size = max(BLOCK, 4 * (before + after + 1))
    if ends == "reflect":
        other = [F.when(F.col("t") < before, -1 - F.col("t")), F.when(F.col("t") >= nsamples - after, 2 * nsamples - 1 - F.col("t"))]
    else:
        other = [F.when(F.col("t") >= nsamples - before, F.col("t") - nsamples), F.when(F.col("t") < after, F.col("t") + nsamples)]
    placed = series.withColumn("p", F.explode(F.array_compact(F.array(F.col("t").cast("long"), *[x.cast("long") for x in other]))))
    own = F.floor(F.col("p") / size)
    # A sample belongs to its block, and to a neighbour whose frames reach it.
    blocks = F.array_distinct(F.array(own, F.floor((F.col("p") + before) / size), F.floor((F.col("p") - after) / size)))
    placed = placed.withColumn("b", F.explode(blocks))
    frame = W.partitionBy("obs_id", "b").orderBy("p").rowsBetween(-before, after)
    out = placed.withColumn("r", made(frame)).where((F.floor(F.col("p") / size) == F.col("b")) & F.col("p").between(0, nsamples - 1))
    return out.select("obs_id", F.col("p").alias("t"), F.col("r").alias("v"))


def lagged(rows: DataFrame, order: str, columns: list[str], default: Column) -> DataFrame:
    """``rows`` with ``last_<column>``: the value of the row numbered one less (``default`` where there is none). Numbers have no gaps; a record is cut into blocks,
    each with the last row of the one before."""
    block = lambda x: F.floor(x / BLOCK)
    spread = rows.withColumn("_b", F.explode(F.array_distinct(F.array(block(F.col(order)), block(F.col(order) + 1)))))
    w = W.partitionBy("obs_id", "_b").orderBy(order)
    made = spread.select("*", *[F.coalesce(F.lag(c).over(w), default).alias(f"last_{c}") for c in columns])
    return made.where(block(F.col(order)) == F.col("_b")).drop("_b")


def _middle(values: Column, size: int) -> Column:
    s = F.array_sort(values)
    return s[size // 2] if size % 2 else (s[size // 2 - 1] + s[size // 2]) / 2


def running_filter(series: DataFrame, nsamples: int, window: int, method: str = "mean") -> DataFrame:
    """The mean or median of the ``window`` samples around each; an even window has one more before than after."""
    if window < 1 or method not in ("mean", "median"):
        raise ValueError("the window must be positive and the method mean or median")
    before, after = window // 2, window // 2 - (window % 2 == 0)
    if method == "mean":
        return framed(series, nsamples, before, after, lambda w: F.avg("v").over(w))
    return framed(series, nsamples, before, after, lambda w: _middle(F.collect_list("v").over(w), window))


def downsample(series: DataFrame, nsamples: int, factor: int, method: str = "mean") -> DataFrame:
    """The mean or median of each ``factor`` samples; the rest at the end is dropped."""
    if factor < 1 or method not in ("mean", "median"):
        raise ValueError("the factor must be positive and the method mean or median")
    kept = series.where(F.col("t") < nsamples // factor * factor)
    return kept.groupBy("obs_id", F.floor(F.col("t") / factor).alias("t")).agg((F.avg("v") if method == "mean" else F.median("v")).alias("v"))


def running_filter_fast(series: DataFrame, nsamples: int, window: int, method: str = "mean", min_points: int = 101) -> DataFrame:
    """A running filter on the downsampled series, interpolated between the centres of its points; level outside of them."""
    factor = max(1, int(window / min_points))
    if factor == 1:
        return running_filter(series, nsamples, window, method)
    points = nsamples // factor
    rough = running_filter(downsample(series, nsamples, factor, method), points, min(min_points, points), method)
    x = (F.col("t") - (factor - 1) / 2) / factor
    low = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(x))).cast("long")
    high = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(x) + 1)).cast("long")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - F.floor(x)))
    asked = series.select("obs_id", "t", low.alias("low"), high.alias("high"), part.alias("part"))
    a, b = rough.select("obs_id", F.col("t").alias("low"), F.col("v").alias("a")), rough.select("obs_id", F.col("t").alias("high"), F.col("v").alias("b"))
    return asked.join(a, ["obs_id", "low"]).join(b, ["obs_id", "high"]).select("obs_id", "t", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v"))


def deredden(series: DataFrame, header: ObsHeader, method: str = "mean", window: float = 0.5, fast: bool = False) -> DataFrame:
    """The series less its running filter over ``window`` seconds."""
    if window < 0:
        raise ValueError("the window must not be negative")
    samples = max(1, round(window / header.tsamp))
    run = running_filter_fast if fast else running_filter
    slow = run(series, header.nsamples, min(samples, header.nsamples), method).withColumnRenamed("v", "slow")
    return series.join(slow, ["obs_id", "t"]).select("obs_id", "t", (F.col("v") - F.col("slow")).alias("v"))


def apply_boxcar(series: DataFrame, nsamples: int, width: int) -> DataFrame:
    """Running mean times the root of the width, moved earlier by half the width, going round."""
    if width < 1:
        raise ValueError("the width must be positive")
    smooth = running_filter(series, nsamples, width)
    return smooth.select("obs_id", F.pmod(F.col("t") - width // 2, F.lit(nsamples)).alias("t"), (F.col("v") * width**0.5).alias("v"))


def detrend(data: DataFrame, by: list[str], order: str = "t", value: str = "v") -> DataFrame:
    """Values less their group's least-squares line."""
    fit = data.groupBy(*by).agg(F.coalesce(F.regr_slope(value, order), F.lit(0.0)).alias("_m"), F.avg(value).alias("_y"), F.avg(order).alias("_x"))
    return data.join(fit, by).withColumn(value, F.col(value) - F.col("_y") - F.col("_m") * (F.col(order) - F.col("_x"))).drop("_m", "_y", "_x")


def pad(series: DataFrame, nsamples: int, total: int, method: str = "mean", offset: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """The series from ``offset`` on among ``total`` samples; the others get its mean, median or, ``zero``, 0. With ``by`` (``c``, say) each group is a series of its own."""
    fill = {"mean": F.avg("v"), "median": F.median("v"), "zero": F.max(F.lit(0.0))}
    if method not in fill or total < nsamples + offset:
        raise ValueError("the method must be mean, median or zero and the total hold the series")
    keys = ["obs_id", *by]
    level = series.groupBy(*keys).agg(fill[method].alias("fill"))  # a row a series
    grid = level.sparkSession.range(total).withColumnRenamed("id", "t").crossJoin(F.broadcast(level))
    return grid.join(series.withColumn("t", F.col("t") + offset), [*keys, "t"], "left").select("obs_id", "t", *by, F.coalesce("v", "fill").alias("v"))


def resample(series: DataFrame, header: ObsHeader, accel: float) -> DataFrame:
    """Samples moved to where constant acceleration would have put them. The last to come to a place stays, a place jumped
    over by one gets the next sample too, and others are 0."""
    total = header.nsamples - 1 if accel > 0 else header.nsamples
    series = series.where(F.col("t") < total)
    p = accel * header.tsamp / (2 * LIGHT_SPEED)
    half = total // 2
    i = F.col("t").cast("double")
    place = (i + F.lit(p) * ((i - half) * (i - half)) - F.lit(p * half * half)).cast("long")
    moved = lagged(series.select("obs_id", "t", "v", place.alias("to")), "t", ["to"], F.lit(0)).withColumnRenamed("last_to", "last")
    writes = moved.select("obs_id", F.explode(F.array_compact(F.array(F.struct("to", "t", F.lit(0).alias("gap"), "v"), F.when(F.col("to") - F.col("last") > 1, F.struct((F.col("to") - 1).alias("to"), "t", F.lit(1).alias("gap"), "v"))))).alias("w"))
    placed = writes.select("obs_id", F.col("w.to").alias("t"), "w").where(F.col("t").between(0, total - 1))
    placed = placed.groupBy("obs_id", "t").agg(F.max_by("w.v", F.struct("w.t", "w.gap")).alias("v"))
    grid = series.select("obs_id", "t")
    return grid.join(placed, ["obs_id", "t"], "left").select("obs_id", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def correlate(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(obs_id, lag, v)``: the full cross-correlation, a pair of series at a time, by transforms."""

    both = a.select("obs_id", "t", "v", F.lit(0).alias("side")).unionAll(b.select("obs_id", "t", "v", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y = (pdf.loc[pdf["side"] == i, "v"].to_numpy(float) for i in (0, 1))
        n = len(x) + len(y) - 1 if len(x) and len(y) else 0
        size = good_size(n)
        full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[:n] if n else np.zeros(0)
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "lag": np.arange(n) - (len(y) - 1), "v": full})

    return both.groupBy("obs_id").applyInPandas(run, "obs_id string, lag long, v double")


def rfft(series: DataFrame, size: int | None = None, transform: Callable[[np.ndarray], np.ndarray] = np.fft.rfft) -> DataFrame:
    """``fseries``: the transform of each series, filled with zeros to a good size; a series is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["v"].to_numpy(float)
        f = transform(np.pad(x, (0, (size or good_size(len(x))) - len(x))))
        return pd.DataFrame({"obs_id": pdf["obs_id"].iloc[0], "k": np.arange(len(f)), "re": f.real, "im": f.imag})

    return series.groupBy("obs_id").applyInPandas(run, "obs_id string, k long, re double, im double")


def fold(series: DataFrame, header: ObsHeader, period: float, accel: float = 0.0, nbins: int = 50, nints: int = 32) -> DataFrame:
    """``cube`` of a series: one band, no delays."""
    from . import filterbank

    one = series.select("obs_id", "t", F.array("v").alias("spec"))
    return filterbank.fold(one, header.updated(nchans=1), period, 0.0, accel, nbins, nints, 1)
