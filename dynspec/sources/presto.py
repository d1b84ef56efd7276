"""Series and transforms in files: ``.tim``, ``.dat`` with ``.inf``, ``.fft`` with ``.inf``, ``.spec``."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import ObsHeader, format_angle
from . import sigproc

# The lines of an .inf file: what they are called, what of the header they hold, how it is written.
INF = {
    "Data file name without suffix": ("basename", "s"),
    "Telescope used": ("telescope", "s"),
    "Instrument used": ("backend", "s"),
    "Object being observed": ("source", "s"),
    "J2000 Right Ascension (hh:mm:ss.ssss)": ("ra", "s"),
    "J2000 Declination     (dd:mm:ss.ssss)": ("dec", "s"),
    "Data observed by": ("observer", "s"),
    "Epoch of observation (MJD)": ("tstart", "05.15f"),
    "Barycentered?           (1 yes, 0 no)": ("barycentric", "d"),
    "Number of bins in the time series": ("nsamples", "-11.0f"),
    "Width of each time series bin (sec)": ("tsamp", ".15g"),
    "Dispersion measure (cm-3 pc)": ("dm", ".12g"),
    "Central freq of low channel (MHz)": ("freq_low", ".12g"),
    "Total bandwidth (MHz)": ("bandwidth", ".12g"),
    "Number of channels": ("nchans", "d"),
    "Channel bandwidth (MHz)": ("foff", ".12g"),
    "Data analyzed by": ("analyser", "s"),
}


def _key(name: str) -> str:
    """Only letters and digits count, as the spelling of units and of ``1=yes`` varies."""
    return "".join(c for c in name.lower() if c.isalnum())


def parse_inf(text: str) -> dict:
    """Values of the lines that are known."""
    known = {_key(n): (k, f) for n, (k, f) in INF.items()}
    out: dict = {}
    for line in text.splitlines():
        # The separator has two spaces before and after it; names may hold a sign of their own.
        name, sep, value = line.partition("  = ")
        if not sep:
            name, sep, value = line.rpartition("=")
        found = known.get(_key(name)) if sep else None
        if found:
            key, fmt = found
            value = value.strip()
            out[key] = value if fmt == "s" else int(float(value)) if key in ("nsamples", "nchans", "barycentric") else float(value)
    return out


def _degrees(text: str, hours: bool) -> float:
    sign = -1 if text.strip().startswith("-") else 1
    a, b, c = (abs(float(x)) for x in text.strip().split(":"))
    return sign * (a + b / 60 + c / 3600) * (15 if hours else 1)


def inf_header(text: str) -> ObsHeader:
    """Of an .inf file; the first channel is the highest one."""
    v = parse_inf(text)
    n, width = v.get("nchans", 1), v.get("foff", 1.0)
    return ObsHeader(
        nchans=n,
        fch1=v.get("freq_low", 0.0) + (n - 1) * width,
        foff=-width,
        tsamp=v["tsamp"],
        nsamples=v["nsamples"],
        nbits=32,
        tstart=v.get("tstart", 0.0),
        data_type="time series",
        source=v.get("source", ""),
        telescope=v.get("telescope", "Fake"),
        backend=v.get("backend", "FAKE"),
        ra=_degrees(v["ra"], True) if "ra" in v else 0.0,
        dec=_degrees(v["dec"], False) if "dec" in v else 0.0,
        frame="barycentric" if v.get("barycentric") else "topocentric",
        dm=v.get("dm", 0.0),
        extra={k: v[k] for k in ("basename", "observer", "analyser") if k in v},
    )


def make_inf(h: ObsHeader, basename: str) -> str:
    values = {
        "basename": basename,
        "telescope": h.telescope,
        "backend": h.backend,
        "source": h.source,
        "ra": format_angle(h.ra, True),
        "dec": format_angle(h.dec),
        "observer": h.extra.get("observer", "unset"),
        "tstart": h.tstart,
        "barycentric": int(h.frame == "barycentric"),
        "nsamples": h.nsamples,
        "tsamp": h.tsamp,
        "dm": h.dm,
        "freq_low": h.fmin,
        "bandwidth": h.bandwidth,
        "nchans": h.nchans,
        "foff": abs(h.foff),
        "analyser": h.extra.get("analyser", "unset"),
    }
    return "".join(f" {name:<39}=  {values[key]:{fmt}}\n" for name, (key, fmt) in INF.items())


def _floats(spark: SparkSession, path: str, skip: int, count: int, obs_id: str, chunk: int = 1 << 18) -> DataFrame:
    """``series`` of a file of 4-byte floats, ``chunk`` of them a row of work."""
    ranges = spark.range(0, -(-count // chunk), 1, max(1, min(200, -(-count // chunk))))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for i in pdf["id"]:
                n = min(chunk, count - i * chunk)
                with open(path, "rb") as f:
                    f.seek(skip + 4 * i * chunk)
                    x = np.frombuffer(f.read(4 * n), "<f4")
                yield pd.DataFrame({"obs_id": obs_id, "t": np.arange(i * chunk, i * chunk + len(x)), "v": x.astype(float)})

    return ranges.mapInPandas(read, "obs_id string, t long, v double")


def read_dat(spark: SparkSession, path: str, inf: str | None = None) -> tuple[DataFrame, ObsHeader]:
    with open(inf or os.path.splitext(path)[0] + ".inf") as f:
        header = inf_header(f.read())
    count = os.path.getsize(path) // 4
    return _floats(spark, path, 0, count, os.path.basename(path)), header.updated(nsamples=count, nchans=1)


def read_tim(spark: SparkSession, path: str) -> tuple[DataFrame, ObsHeader]:
    df, header = sigproc.read_fil(spark, path)
    return df.select("obs_id", "t", F.col("spec")[0].alias("v")), header


def _complex(series: DataFrame) -> DataFrame:
    """Pairs of neighbouring values."""
    pairs = series.groupBy("obs_id", F.floor(F.col("t") / 2).alias("k"))
    return pairs.agg(F.max(F.when(F.col("t") % 2 == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("t") % 2 == 1, F.col("v"))).alias("im"))


def read_fft(spark: SparkSession, path: str, inf: str | None = None) -> tuple[DataFrame, ObsHeader]:
    with open(inf or os.path.splitext(path)[0] + ".inf") as f:
        header = inf_header(f.read())
    return _complex(_floats(spark, path, 0, os.path.getsize(path) // 4, os.path.basename(path))), header.updated(nchans=1)


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, ObsHeader]:
    raw = sigproc.parse_header(path)
    return _complex(_floats(spark, path, raw["hdrlen"], raw["datalen"] // 4, os.path.basename(path))), sigproc.to_header(raw)


def _write(rows: DataFrame, order: str, values: list[str], head: bytes, path: str) -> None:
    """Values in order after a header, through the filterbank writer."""
    sigproc.write_in_order(rows.select(F.col(order).alias("t"), F.array(*values).alias("spec")), head, 32, len(values), path)


def _inf_beside(header: ObsHeader, path: str) -> None:
    base = os.path.splitext(path)[0]
    with open(base + ".inf", "w") as f:
        f.write(make_inf(header, os.path.basename(base)))


def write_dat(series: DataFrame, header: ObsHeader, path: str) -> None:
    _write(series, "t", ["v"], b"", path)
    _inf_beside(header, path)


def write_tim(series: DataFrame, header: ObsHeader, path: str) -> None:
    head = sigproc.encode_header(sigproc.from_header(header.updated(nchans=1, nbits=32, data_type="time series")))
    _write(series, "t", ["v"], head, path)


def write_fft(fseries: DataFrame, header: ObsHeader, path: str) -> None:
    _write(fseries, "k", ["re", "im"], b"", path)
    _inf_beside(header, path)


def write_spec(fseries: DataFrame, header: ObsHeader, path: str) -> None:
    head = sigproc.encode_header(sigproc.from_header(header.updated(nchans=1, nbits=32, data_type="complex spectrum")), True)
    _write(fseries, "k", ["re", "im"], head, path)


