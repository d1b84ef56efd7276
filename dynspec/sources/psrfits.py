"""PSRFITS search-mode files: cards of 80 bytes in blocks of 2880, then the SUBINT binary table, a subintegration a row.

``register`` gives the session the format ``psrfits``; a partition is a range of subintegrations. Options: ``poln`` (``total`` intensity, the default; ``first``
polarisation; ``both`` of the first two, ``all``), ``scloffs`` and ``weights`` (true), ``start`` and ``count`` of subintegrations, ``rows``
of them a partition.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..meta import ObsHeader
from ..runtime import share_package
from . import bits

BLOCK = 2880
# Bytes and types of table columns; states of polarisation by the type of their products.
TFORM = {"L": ("b", 1), "B": ("u1", 1), "A": ("S", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "E": (">f4", 4), "D": (">f8", 8)}
COHERENCE = {"AABB", "AABBCRCI"}
STOKES = {"IQUV"}
INTENSITY = {"AA+BB", "INTEN", "I", "AA"}


def parse_cards(raw: bytes) -> dict:
    out: dict = {}
    for i in range(0, len(raw), 80):
        card = raw[i : i + 80].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            break
        if card[8:10] != "= ":
            continue
        body = card[10:].strip()
        if body.startswith("'"):
            m = re.match(r"'((?:[^']|'')*)'", body)
            out[key] = m[1].replace("''", "'").rstrip() if m else body
            continue
        value = body.split("/")[0].strip()
        if value in ("T", "F"):
            out[key] = value == "T"
        elif value:
            number = value.replace("D", "E")
            try:
                out[key] = int(value) if re.fullmatch(r"[+-]?\d+", value) else float(number)
            except ValueError:
                out[key] = value
    return out


def _header_unit(f) -> dict | None:
    raw = b""
    while True:
        block = f.read(BLOCK)
        if not block.strip():
            return None
        raw += block
        if any(block[i : i + 8] == b"END     " for i in range(0, len(block), 80)):
            return parse_cards(raw)


@dataclass
class Layout:
    """What is where in the file."""

    primary: dict
    subint: dict
    offset: int
    columns: dict[str, tuple[int, str, int]]  # start in the row, type, count

    @property
    def state(self) -> str:
        return str(self.subint.get("POL_TYPE", "")).strip()

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.subint["NSBLK"], self.subint["NPOL"], self.subint["NCHAN"]


def layout(path: str) -> Layout:
    with open(path, "rb") as f:
        primary = _header_unit(f)
        if primary is None or primary.get("FITSTYPE") != "PSRFITS":
            raise ValueError(f"{path} is not a PSRFITS file")
        if primary.get("OBS_MODE") not in ("SEARCH", "SRCH"):
            raise ValueError(f"{path} is not in search mode")
        while (unit := _header_unit(f)) is not None:
            at = f.tell()
            size = abs(unit.get("BITPIX", 8)) // 8 * unit.get("GCOUNT", 1)
            for i in range(unit.get("NAXIS", 0)):
                size *= unit[f"NAXIS{i + 1}"]
            size += unit.get("PCOUNT", 0)
            if unit.get("EXTNAME") == "SUBINT":
                start, columns = 0, {}
                for i in range(1, unit["TFIELDS"] + 1):
                    m = re.match(r"(\d*)([A-Z])", unit[f"TFORM{i}"])
                    count, code = int(m[1] or 1), m[2]
                    if code == "X":
                        kind, width, count = "u1", 1, -(-count // 8)
                    else:
                        kind, width = TFORM[code]
                    columns[unit[f"TTYPE{i}"].strip()] = (start, kind, count)
                    start += width * count
                return Layout(primary, unit, at, columns)
            f.seek(at + -(-size // BLOCK) * BLOCK)
    raise ValueError(f"{path} has no SUBINT table")


def read_row(f, lay: Layout, isub: int) -> dict[str, np.ndarray]:
    """A subintegration's columns."""
    size = lay.subint["NAXIS1"]
    f.seek(lay.offset + isub * size)
    raw = f.read(size)
    out = {}
    for name, (start, kind, count) in lay.columns.items():
        if kind != "S":
            out[name] = np.frombuffer(raw, kind, count, start)
    return out


def decode_row(row: dict[str, np.ndarray], lay: Layout, scloffs: bool = True, weights: bool = True) -> np.ndarray:
    """Samples x polarisations x channels of a subintegration: unpacked, scaled and weighted."""
    nsblk, npol, nchan = lay.shape
    nbits = lay.subint["NBITS"]
    data = row["DATA"]
    if nbits < 8:
        x = bits.unpack(data.view(np.uint8), nbits, "big").astype(float)
    elif nbits == 8:
        x = data.view(np.int8 if lay.subint.get("SIGNINT") else np.uint8).astype(float)
    else:
        x = data.astype(float)
    x = x[: nsblk * npol * nchan].reshape(nsblk, npol, nchan) - float(lay.subint.get("ZERO_OFF") or 0)
    if scloffs:
        x = x * row["DAT_SCL"].astype(float).reshape(npol, nchan) + row["DAT_OFFS"].astype(float).reshape(npol, nchan)
    return x * row["DAT_WTS"].astype(float) if weights else x


def select(x: np.ndarray, state: str, poln: str) -> np.ndarray:
    """Samples x channels, one after the other for each polarisation kept."""
    if poln == "all":
        return x.reshape(len(x), -1)
    if poln == "both":
        return x[:, :2].reshape(len(x), -1)
    if poln == "first" or state not in COHERENCE or x.shape[1] < 2:
        return x[:, 0]
    return (x[:, 0] + x[:, 1]) / np.sqrt(2)


def to_header(lay: Layout) -> ObsHeader:
    p, s = lay.primary, lay.subint
    nsblk, _, nchan = lay.shape
    width = s.get("CHAN_BW") or p["OBSBW"] / nchan
    top = p["OBSFREQ"] + abs(width) * (nchan - 1) / 2
    tstart = p.get("STT_IMJD", 0) + (p.get("STT_SMJD", 0) + p.get("STT_OFFS", 0.0)) / 86400 + s.get("NSUBOFFS", 0) * nsblk * s["TBIN"] / 86400

    def degrees(text: str, hours: bool) -> float:
        a, b, c = (float(v) for v in str(text).lstrip("+-").split(":"))
        return (-1 if str(text).startswith("-") else 1) * (a + b / 60 + c / 3600) * (15 if hours else 1)

    return ObsHeader(
        nchans=nchan,
        fch1=top,
        foff=-abs(width),
        tsamp=s["TBIN"],
        nsamples=nsblk * s["NAXIS2"],
        nbits=s["NBITS"],
        tstart=tstart,
        source=str(p.get("SRC_NAME", "")),
        telescope=str(p.get("TELESCOP", "Fake")),
        backend=str(p.get("BACKEND", "FAKE")),
        ra=degrees(p.get("RA", "0:0:0"), True),
        dec=degrees(p.get("DEC", "0:0:0"), False),
        dm=float(s.get("DM") or s.get("CHAN_DM") or 0),
        extra={"state": lay.state, "project": p.get("PROJID"), "receiver": p.get("FRONTEND"), "observer": p.get("OBSERVER")},
    )


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class PsrfitsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        path = self.options["path"].removeprefix("file://")
        n = layout(path).subint["NAXIS2"]
        start = int(self.options.get("start", 0))
        stop = start + int(self.options["count"]) if "count" in self.options else n
        if not 0 <= start <= stop <= n:
            raise ValueError("subintegrations out of range")
        step = int(self.options.get("rows", 16))
        return [Rows(path, i, min(i + step, stop)) for i in range(start, stop, step)]

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        lay, o = layout(p.path), self.options
        yes = lambda k: o.get(k, "true") == "true"
        with open(p.path, "rb") as f:
            for i in range(p.first, p.last):
                row = read_row(f, lay, i)
                x = select(decode_row(row, lay, yes("scloffs"), yes("weights")), lay.state, o.get("poln", "total"))
                if np.all(np.diff(row["DAT_FREQ"].astype(float)) > 0) and len(row["DAT_FREQ"]) > 1:
                    n = lay.shape[2]
                    x = x.reshape(len(x), -1, n)[:, :, ::-1].reshape(len(x), -1)  # the highest frequency first
                t = np.arange(i * len(x), (i + 1) * len(x), dtype=np.int64)
                edges = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(p.path)] * len(x)), pa.array(t), pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(x).ravel()))], ["obs_id", "t", "spec"])


class PsrfitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "psrfits"

    def schema(self) -> str:
        return "obs_id string, t long, spec array<double>"

    def reader(self, schema) -> PsrfitsReader:
        return PsrfitsReader(dict(self.options))


def subint_columns(spark: SparkSession, path: str):
    """``(isub, c, freq, weight, pol, scale, offset)`` of every subintegration, channel and polarisation."""
    lay = layout(path)
    _, npol, nchan = lay.shape

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for i in pdf["id"]:
                with open(path, "rb") as f:
                    row = read_row(f, lay, i)
                flat = lambda k: row[k].astype(float)
                yield pd.DataFrame({"isub": int(i), "c": np.tile(np.arange(nchan), npol), "freq": np.tile(flat("DAT_FREQ"), npol), "weight": np.tile(flat("DAT_WTS"), npol), "pol": np.repeat(np.arange(npol), nchan), "scale": flat("DAT_SCL"), "offset": flat("DAT_OFFS")})

    return spark.range(lay.subint["NAXIS2"]).mapInPandas(read, "isub long, c int, freq double, weight double, pol int, scale double, offset double")


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(PsrfitsSource)


def read_psrfits(spark: SparkSession, path: str, **options):
    register(spark)
    df = spark.read.format("psrfits").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)
    return df, to_header(layout(path))
