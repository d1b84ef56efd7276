"""Tables of the engine and adapters to them.

``spectra(obs_id, t, spec array<double>)``: a row per time sample, as files hold it; operators that work within a sample use it
without a shuffle. ``fb(obs_id, t, c, v)``: a row per cell. ``series(obs_id, t, v)``, ``fseries(obs_id, k, re, im)``,
``spectrum(obs_id, nfold, k, p)``, ``dmt(obs_id, dm, t, v)``, ``cube(obs_id, subint, band, bin, v, n)``: what is derived.
Lengths (``nsamples``, ``nchans``) come from the header, so no operator counts rows to plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meta import ObsHeader
from .runtime import share_package

#: The header that the vectors of ``embeddings`` get when they play the part of a filterbank.
SYNTHETIC = ObsHeader(nchans=64, fch1=1400.0, foff=-1.0, tsamp=0.001, nbits=32, tstart=58543.0)


def embeddings_spectra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ObsHeader]:
    """The vectors as spectra, and their header; the row count comes from file footers."""
    share_package(spark)
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    spectra = raw.select(F.lit("emb").alias("obs_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("spec"))
    return spectra, SYNTHETIC.updated(nsamples=raw.count())


def explode_spectra(spectra: DataFrame) -> DataFrame:
    """``spectra`` to ``fb``."""
    return spectra.select("obs_id", "t", F.posexplode("spec").alias("c", "v"))


def pack_spectra(fb: DataFrame) -> DataFrame:
    """``fb`` to ``spectra``; channels in order, absent ones left out."""
    cells = F.sort_array(F.collect_list(F.struct("c", "v")))
    return fb.groupBy("obs_id", "t").agg(F.transform(cells, lambda x: x["v"]).alias("spec"))


def events_series(spark: SparkSession, sf_dir: str, tsamp_s: int = 3600) -> DataFrame:
    """``events`` of each type as a regular series of summed values; empty bins are 0."""
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    rows = raw.select(F.col("event_type").alias("obs_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (tsamp_s * 1_000_000)).alias("b"), "value")
    binned = rows.groupBy("obs_id", "b").agg(F.sum("value").alias("v"))
    ends = binned.groupBy().agg(F.min("b").alias("low"), F.max("b").alias("high"))
    grid = binned.select("obs_id").distinct().crossJoin(F.broadcast(ends)).select("obs_id", "low", F.explode(F.sequence("low", "high")).alias("b"))
    return grid.join(binned, ["obs_id", "b"], "left").select("obs_id", (F.col("b") - F.col("low")).alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"))
