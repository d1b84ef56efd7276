"""Location and scale of groups of values, and scores against them.

Every function takes the columns that make the groups, so a channel, a sample or a whole record is one argument away. Quantiles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IQR_NORMAL = 1.3489795003921634
MAD_NORMAL = 0.6744897501960817
MEAN_DEVIATION_NORMAL = math.sqrt(2 / math.pi)
QN_NORMAL = 0.4506241100243562
SN_NORMAL = 1.1926
#: Values of a group whose pairs are formed at most.
MOST_PAIRED = 1 << 14
BIWEIGHT_TUNING = 9.0


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``a`` with their group's row of ``b``."""
    return a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))


def _median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def _deviation_scale(mad: Column, mean_dev: Column) -> Column:
    """A median absolute deviation as a standard deviation; where it is 0, the mean one serves."""
    return F.when(F.abs(mad) > 1e-12, mad / MAD_NORMAL).otherwise(mean_dev / MEAN_DEVIATION_NORMAL)


def location(data: DataFrame, by: Sequence[str], method: str = "median", value: str = "v") -> DataFrame:
    """``by, loc``."""
    if method not in ("median", "mean"):
        raise ValueError("method must be median or mean")
    return data.groupBy(*by).agg((_median(F.col(value)) if method == "median" else F.avg(value)).alias("loc"))


def _mad(data: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    met = _same(data, location(data, by, "median", value), by)
    dev = F.abs(F.col(value) - F.col("loc"))
    return met.groupBy(*by).agg(_deviation_scale(_median(dev), F.avg(dev)).alias("scale"))


def _double_mad(data: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    met = _same(data, location(data, by, "median", value), by)
    dev = F.abs(F.col(value) - F.col("loc"))
    sides = {"left": F.col(value) <= F.col("loc"), "right": F.col(value) >= F.col("loc")}
    return met.groupBy(*by).agg(F.first("loc").alias("mid"), *[_deviation_scale(_median(F.when(on, dev)), F.avg(F.when(on, dev))).alias(side) for side, on in sides.items()])


def _diffcov(data: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order)
    d = data.withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_e", F.lead("_d").over(w)).where("_d IS NOT NULL AND _e IS NOT NULL")
    return d.groupBy(*by).agg(F.sqrt(F.abs(F.covar_samp("_d", "_e"))).alias("scale"))


def _biweight(data: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    met = _same(data, location(data, by, "median", value), by).withColumn("_x", F.col(value) - F.col("loc"))
    raw = met.groupBy(*by).agg(_median(F.abs("_x")).alias("_mad"), F.count("*").alias("_n"))
    u = _same(met, raw, by).withColumn("_u", F.col("_x") / (BIWEIGHT_TUNING * F.col("_mad")))
    inside = F.abs("_u") < 1
    q = 1 - F.col("_u") * F.col("_u")
    top = F.sum(F.when(inside, F.col("_x") * F.col("_x") * q * q * q * q))
    low = F.sum(F.when(inside, q * (1 - 5 * F.col("_u") * F.col("_u"))))
    return u.where("_mad > 0").groupBy(*by).agg((F.sqrt(F.max("_n")) * F.sqrt(top) / F.abs(low)).alias("scale"))


def _pairs(data: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """Differences of all pairs of a group, each value with itself included: for groups of the size of a band. A larger group is refused, with an error when it is met."""
    n = data.groupBy(*by).agg(F.count("*").alias("_n"))
    fits = F.when(F.col("_n") <= MOST_PAIRED, True).otherwise(F.raise_error(F.lit(f"a group has more than {MOST_PAIRED} values, too many to pair")).cast("boolean"))
    left = _same(data.select(*by, F.col(order).alias("_i"), F.col(value).alias("_x")), n, by).where(fits).drop("_n")
    right = data.select(*by, F.col(order).alias("_j"), F.col(value).alias("_y"))
    return _same(left, right, by).select(*by, "_i", "_j", F.abs(F.col("_x") - F.col("_y")).alias("_d"))


def _qn(data: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    n = data.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = _same(_pairs(data, by, value, order).where("_i < _j"), n, by).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_d")))
    h = F.floor(F.col("_n") / 2) + 1
    return ranked.where(F.col("_r") == h * (h - 1) / 2).select(*by, (F.col("_d") / QN_NORMAL).alias("scale"))


def _sn(data: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    inner = _pairs(data, by, value, order).groupBy(*by, "_i").agg(_median(F.col("_d")).alias("_m"))
    return inner.groupBy(*by).agg((SN_NORMAL * _median(F.col("_m"))).alias("scale"))


def _gapper(data: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(value)
    n = data.groupBy(*by).agg(F.count("*").alias("_n"))
    gaps = _same(data.select(*by, value, F.row_number().over(w).alias("_i"), (F.lead(value).over(w) - F.col(value)).alias("_g")), n, by)
    weighted = F.sum(F.col("_i") * (F.col("_n") - F.col("_i")) * F.col("_g"))
    return gaps.groupBy(*by).agg((F.coalesce(weighted, F.lit(0.0)) * math.sqrt(math.pi) / F.greatest(F.lit(1), F.max("_n") * (F.max("_n") - 1))).alias("scale"))


def scale(data: DataFrame, by: Sequence[str], method: str = "mad", value: str = "v", order: str = "t") -> DataFrame:
    """``by, scale`` (for ``doublemad``: ``by, mid, left, right``). ``order`` tells the values of a group apart and orders them."""
    by = list(by)
    if method == "std":
        return data.groupBy(*by).agg(F.stddev_pop(value).alias("scale"))
    if method == "iqr":
        q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
        return data.groupBy(*by).agg(((q[1] - q[0]) / IQR_NORMAL).alias("scale"))
    made = {
        "mad": lambda: _mad(data, by, value),
        "doublemad": lambda: _double_mad(data, by, value),
        "diffcov": lambda: _diffcov(data, by, value, order),
        "biweight": lambda: _biweight(data, by, value),
        "qn": lambda: _qn(data, by, value, order),
        "sn": lambda: _sn(data, by, value, order),
        "gapper": lambda: _gapper(data, by, value),
    }
    if method not in made:
        raise ValueError(f"unknown scale {method!r}")
    return made[method]()


def zscore(data: DataFrame, by: Sequence[str], loc_method: str = "median", scale_method: str = "mad", value: str = "v", order: str = "t") -> DataFrame:
    """``data`` with ``z, loc, scale``; a scale of about 0 counts as 1, ``norm`` means location 0 or scale 1."""
    by = list(by)
    loc = data.groupBy(*by).agg(F.lit(0.0).alias("loc")) if loc_method == "norm" else location(data, by, loc_method, value)
    out = _same(data, loc, by)
    if scale_method == "norm":
        out = out.withColumn("scale", F.lit(1.0))
    elif scale_method == "doublemad":
        out = _same(out, scale(data, by, "doublemad", value), by)
        out = out.withColumn("scale", F.when(F.col(value) < F.col("mid"), F.col("left")).otherwise(F.col("right"))).drop("mid", "left", "right")
    else:
        out = _same(out, scale(data, by, scale_method, value, order), by)
    out = out.withColumn("scale", F.when(F.abs("scale") > 1e-12, F.col("scale")).otherwise(1.0))
    return out.withColumn("z", (F.col(value) - F.col("loc")) / F.col("scale"))


def normalise(data: DataFrame, by: Sequence[str], loc_method: str = "mean", scale_method: str = "std", value: str = "v", order: str = "t") -> DataFrame:
    """``data`` with its values as scores."""
    out = zscore(data, by, loc_method, scale_method, value, order)
    return out.withColumn(value, F.col("z")).drop("z", "loc", "scale")
