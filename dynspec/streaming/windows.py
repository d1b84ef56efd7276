"""Structured Streaming forms: windowed statistics, running rescale, dedispersion with carried samples.

State is bounded: sums per window until the watermark passes, moments per channel, and the last ``max delay`` samples of a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..meta import ObsHeader


def read_events(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream of the ``events`` files in a folder; time stamps are UTC."""
    kind = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    raw = spark.readStream.schema(kind).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Count, sum, mean, least and greatest value of each key and window, of a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.groupBy(frame.alias("w"), key).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean", "low", "high")


def session_stats(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions of each key: events closer than ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def rescale(fb: DataFrame) -> DataFrame:
    """Each cell by the mean and deviation of its channel up to and including it."""
    w = W.partitionBy("obs_id", "c").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    s = F.stddev_pop("v").over(w)
    return fb.select("obs_id", "t", "c", ((F.col("v") - F.avg("v").over(w)) / F.when(s > 1e-5, s).otherwise(1.0)).alias("v"))


def rescale_stream(fb: DataFrame, samples: int = 16384, constant: bool = False) -> DataFrame:
    """The same of a stream, with statistics of the last ``samples`` cells at least, or (``constant``) of the first."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s1, s2, mean, sd = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        known = sd > 0
        for pdf in batches:
            pdf = pdf.sort_values("t")
            v = pdf["v"].to_numpy(float)
            n, s1, s2 = n + len(v), s1 + float(v.sum()), s2 + float((v * v).sum())
            if not known or (n >= samples and not constant):
                mean, sd, known = s1 / n, float(np.sqrt(max(0.0, s2 / n - (s1 / n) ** 2))), True
                sd = sd if sd > 1e-5 else 1.0
                if n >= samples:
                    n, s1, s2 = 0, 0.0, 0.0
            yield pd.DataFrame({"obs_id": key[0], "t": pdf["t"], "c": key[1], "v": (v - mean) / sd})
        state.update((n, s1, s2, mean, sd))

    return fb.groupBy("obs_id", "c").applyInPandasWithState(run, "obs_id string, t long, c int, v double", "n long, s1 double, s2 double, mean double, sd double", "append", GroupStateTimeout.NoTimeout)


def dedisperse_stream(spectra: DataFrame, header: ObsHeader, dm: float) -> DataFrame:
    """The dedispersed series of a stream of spectra in order; the last samples wait for those that they need."""
    d = header.delays(dm)
    if d.min() < 0:
        raise ValueError("the reference must be the highest frequency")
    keep, chans = int(d.max()), np.arange(header.nchans)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = (state.get[0], np.array(state.get[1], float).reshape(-1, header.nchans)) if state.exists else (None, np.zeros((0, header.nchans)))
        rows = pd.concat(batches).sort_values("t")
        if len(rows):
            first = int(rows["t"].iloc[0]) if first is None else first
            x = np.vstack([held, *[np.asarray(s, float)[None, :] for s in rows["spec"]]])
            n = max(0, len(x) - keep)
            if n:
                at = np.arange(n)[:, None] + d[None, :]
                yield pd.DataFrame({"obs_id": key[0], "t": np.arange(first, first + n), "v": x[at, chans[None, :]].sum(axis=1)})
            state.update((first + n, x[n:].ravel().tolist()))

    return spectra.groupBy("obs_id").applyInPandasWithState(run, "obs_id string, t long, v double", "first long, held array<double>", "append", GroupStateTimeout.NoTimeout)
