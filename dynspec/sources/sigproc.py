"""The filterbank format: a header of length-prefixed keys and values, then samples, frequency fastest.

``register`` gives the session the formats ``fil`` (read, write). Options of the reader: ``chunk`` (samples a partition, 16384), ``start``,
``nsamps``, ``contiguous`` (true: files must follow each other in time). A path may list files with commas; they are read as one
stream; ``chan`` and ``nchans`` keep that many channels from one on. Files are opened where they are read, so they must be on a file system that all executors mount.
"""

from __future__ import annotations

import glob
import math
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..meta import DATA_TYPES, MACHINES, TELESCOPES, ObsHeader, name_of, pack_angle, parse_angle
from ..runtime import share_package
from . import bits

# The keys of the format and their binary types ("" is a string).
KEYS = {
    "telescope_id": "<I",
    "machine_id": "<I",
    "data_type": "<I",
    "rawdatafile": "",
    "source_name": "",
    "barycentric": "<I",
    "pulsarcentric": "<I",
    "az_start": "<d",
    "za_start": "<d",
    "src_raj": "<d",
    "src_dej": "<d",
    "tstart": "<d",
    "tsamp": "<d",
    "nbits": "<I",
    "nsamples": "<I",
    "fch1": "<d",
    "foff": "<d",
    "nchans": "<I",
    "nifs": "<I",
    "refdm": "<d",
    "period": "<d",
    "signed": "b",
    "ibeam": "<I",
    "nbeams": "<I",
}
START, END = "HEADER_START", "HEADER_END"
LONGEST = 4096


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<I", len(raw)) + raw


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, fmt: str):
        size = struct.calcsize(fmt)
        if self.at + size > len(self.data):
            raise ValueError("the header ends early")
        (v,) = struct.unpack_from(fmt, self.data, self.at)
        self.at += size
        return v

    def text(self) -> str:
        n = self.take("<I")
        if not 1 <= n <= LONGEST or self.at + n > len(self.data):
            raise ValueError(f"a string of {n} bytes at {self.at - 4}")
        raw = self.data[self.at : self.at + n]
        self.at += n
        return raw.decode()

    def skip_unknown(self) -> None:
        """Past a value of unknown type: the first size after which another key follows."""
        for size in (4, 8, 1):
            probe = _Cursor(self.data)
            probe.at = self.at + size
            try:
                name = probe.text()
            except (ValueError, UnicodeDecodeError):
                continue
            if name in KEYS or name == END or name.isidentifier():
                self.at += size
                return
        raise ValueError(f"an unknown key's value at {self.at}")


def parse_header_bytes(data: bytes) -> dict:
    """Keys, values and ``hdrlen``."""
    c = _Cursor(data)
    try:
        if c.text() != START:
            raise ValueError("not a filterbank header")
        out: dict = {}
        while (key := c.text()) != END:
            if key not in KEYS:
                c.skip_unknown()
            else:
                out[key] = c.take(KEYS[key]) if KEYS[key] else c.text()
    except UnicodeDecodeError as e:
        raise ValueError("a key that is not text") from e
    return out | {"hdrlen": c.at}


def parse_header(path: str) -> dict:
    """The header of a file, with ``hdrlen``, ``filelen``, ``datalen``, ``nsamples`` and ``filename``; samples follow from the file's length."""
    with open(path, "rb") as f:
        out = parse_header_bytes(f.read(1 << 20))
    size = os.path.getsize(path)
    out |= {"filelen": size, "datalen": size - out["hdrlen"], "filename": path}
    found = 8 * out["datalen"] // out.get("nbits", 32) // out.get("nchans", 1) // max(1, out.get("nifs", 1))
    out["nsamples"] = min(found, out["nsamples"]) if out.get("nsamples") else found
    return out


def parse_headers(paths: Sequence[str], contiguous: bool = True) -> tuple[dict, list[dict]]:
    """The header of files read as one, and of each: all keys but the start must agree, and with ``contiguous`` each must begin where the last ends, to a tenth of a sample."""
    every = [parse_header(p) for p in paths]
    own = {"tstart", "rawdatafile", "filename", "hdrlen", "filelen", "datalen", "nsamples"}
    for h in every[1:]:
        differ = [k for k in KEYS if k not in own and h.get(k) != every[0].get(k)]
        if differ:
            raise ValueError(f"headers differ in {differ}")
    for a, b in zip(every, every[1:]):
        gap = (b["tstart"] - a["tstart"]) * 86400 - a["nsamples"] * a["tsamp"]
        if contiguous and abs(gap) > 0.1 * a["tsamp"]:
            raise ValueError(f"{b['filename']} does not follow {a['filename']}: {gap} s between them")
    return every[0] | {"nsamples": sum(h["nsamples"] for h in every)}, every


def encode_header(values: dict, with_nsamples: bool = False) -> bytes:
    """Keys in the order of the format."""
    out = _text(START)
    for key, fmt in KEYS.items():
        if key in values and (key != "nsamples" or with_nsamples):
            out += _text(key) + (struct.pack(fmt, values[key]) if fmt else _text(str(values[key])))
    return out + _text(END)


def edit_header(path: str, key: str, value) -> None:
    """Change a value in place; strings keep their length."""
    old = parse_header(path)
    if key not in KEYS or key not in old:
        raise ValueError(f"the header has no {key!r}")
    if not KEYS[key]:
        value = str(value)[: len(old[key])].ljust(len(old[key]))
    with open(path, "r+b") as f:
        raw = f.read(old["hdrlen"])
        mark = _text(key)
        at = raw.index(mark) + len(mark)
        new = struct.pack(KEYS[key], value) if KEYS[key] else _text(value)
        changed = raw[:at] + new + raw[at + len(new) :]
        if len(changed) != len(raw):
            raise ValueError("the header's size would change")
        f.seek(0)
        f.write(changed)


def to_header(raw: dict) -> ObsHeader:
    frame = "pulsarcentric" if raw.get("pulsarcentric") else "barycentric" if raw.get("barycentric") else "topocentric"
    return ObsHeader(
        nchans=raw["nchans"],
        fch1=raw["fch1"],
        foff=raw["foff"],
        tsamp=raw["tsamp"],
        nsamples=raw["nsamples"],
        nbits=raw["nbits"],
        tstart=raw.get("tstart", 0.0),
        nifs=raw.get("nifs", 1),
        data_type=name_of(DATA_TYPES, raw.get("data_type", 1), "filterbank"),
        source=raw.get("source_name", ""),
        telescope=name_of(TELESCOPES, raw.get("telescope_id", 0), "Fake"),
        backend=name_of(MACHINES, raw.get("machine_id", 0), "FAKE"),
        ra=parse_angle(raw.get("src_raj", 0.0), True),
        dec=parse_angle(raw.get("src_dej", 0.0)),
        azimuth=raw.get("az_start", 0.0),
        zenith=raw.get("za_start", 0.0),
        frame=frame,
        ibeam=raw.get("ibeam", 0),
        nbeams=raw.get("nbeams", 0),
        dm=raw.get("refdm", 0.0),
        period=raw.get("period", 0.0),
        signed=bool(raw.get("signed", 0)),
        rawdatafile=raw.get("rawdatafile", ""),
    )


def from_header(h: ObsHeader) -> dict:
    out = {
        "telescope_id": TELESCOPES.get(h.telescope, 0),
        "machine_id": MACHINES.get(h.backend, 0),
        "data_type": DATA_TYPES.get(h.data_type, 1),
        "rawdatafile": h.rawdatafile,
        "source_name": h.source,
        "barycentric": int(h.frame == "barycentric"),
        "pulsarcentric": int(h.frame == "pulsarcentric"),
        "az_start": h.azimuth,
        "za_start": h.zenith,
        "src_raj": pack_angle(h.ra, True),
        "src_dej": pack_angle(h.dec),
        "tstart": h.tstart,
        "tsamp": h.tsamp,
        "nbits": h.nbits,
        "nsamples": h.nsamples,
        "fch1": h.fch1,
        "foff": h.foff,
        "nchans": h.nchans,
        "nifs": h.nifs,
        "refdm": h.dm,
        "period": h.period,
        "signed": int(h.signed),
        "ibeam": h.ibeam,
        "nbeams": h.nbeams,
    }
    return {k: v for k, v in out.items() if v != ""}


def read_header(paths: str | Sequence[str], contiguous: bool = True) -> ObsHeader:
    return to_header(parse_headers(_files(paths), contiguous)[0])


def _files(paths: str | Sequence[str]) -> list[str]:
    parts = paths.split(",") if isinstance(paths, str) else list(paths)
    found = [f for p in parts for f in (sorted(glob.glob(p)) if any(x in p for x in "*?[") else [p])]
    return [f.removeprefix("file://") for f in found]


@dataclass
class Piece(InputPartition):
    path: str
    offset: int  # of the first sample, in bytes
    samples: int
    first: int  # its number in the stream
    nchans: int
    nbits: int
    obs_id: str


def pieces(paths: Sequence[str], chunk: int, start: int = 0, nsamps: int | None = None, contiguous: bool = True) -> list[Piece]:
    """Ranges of samples of a stream of files, ``chunk`` samples at most."""
    whole, every = parse_headers(paths, contiguous)
    stop = whole["nsamples"] if nsamps is None else start + nsamps
    if not 0 <= start <= stop <= whole["nsamples"]:
        raise ValueError("samples out of range")
    out, base = [], 0
    for h in every:
        bits_a_sample = h["nchans"] * h["nbits"]
        at, end = max(start - base, 0), min(stop - base, h["nsamples"])
        while at < end:
            n = min(chunk, end - at)
            if at * bits_a_sample % 8:
                raise ValueError("samples do not start at whole bytes")
            out.append(Piece(h["filename"], h["hdrlen"] + at * bits_a_sample // 8, n, base + at, h["nchans"], h["nbits"], os.path.basename(paths[0])))
            at += n
        base += h["nsamples"]
    return out


class FilReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        o = self.options
        nsamps = int(o["nsamps"]) if "nsamps" in o else None
        return pieces(_files(o["path"]), int(o.get("chunk", 16384)), int(o.get("start", 0)), nsamps, o.get("contiguous", "true") == "true")

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        low = int(self.options.get("chan", 0))
        kept = min(int(self.options.get("nchans", p.nchans)), p.nchans - low)
        with open(p.path, "rb") as f:
            f.seek(p.offset)
            at, rows = 0, max(1, (4 << 20) // (8 * p.nchans))
            while at < p.samples:
                n = min(rows, p.samples - at)
                need = (n * p.nchans * p.nbits + 7) // 8
                raw = f.read(need)
                if len(raw) < need:
                    raise ValueError(f"{p.path} ends early")
                x = bits.decode(raw, p.nbits)[: n * p.nchans].reshape(n, p.nchans)[:, low : low + kept].astype(np.float64).ravel()
                spec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * kept), pa.array(x))
                t = pa.array(np.arange(p.first + at, p.first + at + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([p.obs_id] * n), t, spec], ["obs_id", "t", "spec"])
                at += n


@dataclass
class Written(WriterCommitMessage):
    samples: int


class FilWriter(DataSourceArrowWriter):
    """Every task writes its samples to their own place in one new file, which gets its name when all are there.

    A place follows from the sample's number, so no byte passes through the driver, and a task that runs again writes the same bytes over. The rows must be range-partitioned at whole bytes and
    sorted by ``t`` (``write_in_order`` does that), one record at a time.
    """

    def __init__(self, options: dict) -> None:
        self.path = _files(options["path"])[0]
        self.made = f"{self.path}.{options['run']}.new"
        self.header = bytes.fromhex(options["header"])
        self.nbits, self.nchans = int(options["nbits"]), int(options["nchans"])
        self.first, self.count = int(options["first"]), int(options["count"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        step = 8 // math.gcd(8, self.nchans * self.nbits)
        rest, at, done = np.zeros((0, self.nchans)), None, 0
        with os.fdopen(os.open(self.made, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:

            def put(x: np.ndarray) -> None:
                f.seek(len(self.header) + at * self.nchans * self.nbits // 8)
                f.write(bits.encode(x.ravel(), self.nbits))

            for b in batches:
                if not len(b):
                    continue
                t = b.column("t").to_numpy() - self.first
                at = int(t[0]) if at is None else at
                x = np.asarray(b.column("spec").flatten().to_numpy(zero_copy_only=False), float)
                if len(x) != len(b) * self.nchans:
                    raise ValueError("a sample has another number of channels than the header")
                if t[0] != at + len(rest) or (np.diff(t) != 1).any():
                    raise ValueError("samples are missing or repeated")
                if self.nbits < 32:
                    x = np.clip(np.rint(x), 0, 2**self.nbits - 1)
                x = np.concatenate([rest, x.reshape(-1, self.nchans)])
                whole = len(x) // step * step
                put(x[:whole])
                rest, at, done = x[whole:], at + whole, done + len(b)
            if len(rest):  # only at the end of the file: filled up to a whole byte
                put(np.pad(rest.ravel(), (0, -rest.size % max(1, 8 // self.nbits))))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        if sum(m.samples for m in messages if m is not None) != self.count:
            self.abort(messages)
            raise ValueError("samples are missing or repeated")
        with open(self.made, "r+b" if os.path.exists(self.made) else "w+b") as f:
            f.write(self.header)
            f.truncate(len(self.header) + (self.count * self.nchans * self.nbits + 7) // 8)
        os.replace(self.made, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.made):
            os.remove(self.made)


class FilSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fil"

    def schema(self) -> str:
        return "obs_id string, t long, spec array<double>"

    def reader(self, schema) -> FilReader:
        return FilReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FilWriter:
        return FilWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    share_package(spark)
    spark.dataSource.register(FilSource)


def read_fil(spark: SparkSession, paths: str | Sequence[str], **options):
    """``spectra`` of files, and their header."""
    register(spark)
    joined = paths if isinstance(paths, str) else ",".join(paths)
    df = spark.read.format("fil").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(joined)
    return df, read_header(paths, options.get("contiguous", True))


def read_fil_block(spark: SparkSession, paths: str | Sequence[str], start: int, nsamps: int, fch1: float | None = None, nchans: int | None = None, **options):
    """The same rectangle as ``filterbank.read_block`` gives of the whole, and its header; other samples are not read and other channels not kept.

    Ranges are options of the reader and not filters pushed into it: sessions share what is pushed between plans of one DataFrame, so one plan's filter would reach the others.
    """
    from ..operators.filterbank import block_header

    chan, kept, head = block_header(read_header(paths, options.get("contiguous", True)), start, nsamps, fch1, nchans)
    step = _whole_bytes(paths, start)
    df, _ = read_fil(spark, paths, start=step, nsamps=nsamps + start - step, chan=chan, nchans=kept, **options)
    return df.where(F.col("t") >= start).withColumn("t", F.col("t") - start), head


def _whole_bytes(paths: str | Sequence[str], start: int) -> int:
    """The last sample up to ``start`` that begins at a whole byte of its file."""
    base = 0
    for h in parse_headers(_files(paths), False)[1]:
        if start < base + h["nsamples"]:
            break
        base += h["nsamples"]
    step = 8 // math.gcd(8, h["nchans"] * h["nbits"])
    return base + (start - base) // step * step


def write_in_order(rows: DataFrame, header: bytes, nbits: int, nchans: int, path: str) -> None:
    """``rows(t, spec)``, whose numbers have no gaps, as one file after ``header``. Partitions begin at every eighth sample, and so at whole bytes."""
    register(rows.sparkSession)
    ends = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    first, count = (ends.low, ends.high - ends.low + 1) if ends.low is not None else (0, 0)
    ordered = rows.select("t", "spec").repartitionByRange(F.floor((F.col("t") - first) / 8)).sortWithinPartitions("t")
    options = {"header": header.hex(), "nbits": nbits, "nchans": nchans, "first": first, "count": count, "run": uuid.uuid4().hex}
    ordered.write.format("fil").mode("append").options(**{k: str(v) for k, v in options.items()}).save(path)


def write_fil(spectra: DataFrame, header: ObsHeader, path: str) -> None:
    """One file of all samples, in order."""
    write_in_order(spectra, encode_header(from_header(header)), header.nbits, header.nchans, path)
