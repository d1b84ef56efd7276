"""Observation headers: what a regularly sampled time x frequency record is described by."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from datetime import UTC, datetime, timedelta

import numpy as np

DM_CONSTANT = 4.148808e3  # s MHz^2 / (pc cm^-3)
LIGHT_SPEED = 299792458.0

# Codes of the filterbank file format.
TELESCOPES = {
    "Fake": 0,
    "Arecibo": 1,
    "Ooty": 2,
    "Nancay": 3,
    "Parkes": 4,
    "Jodrell": 5,
    "GBT": 6,
    "GMRT": 7,
    "Effelsberg": 8,
    "Effelsberg LOFAR": 9,
    "SRT": 10,
    "LOFAR": 11,
    "VLA": 12,
    "CHIME": 20,
    "MWA": 30,
    "MeerKAT": 64,
    "NC": 40,
    "NGNC": 41,
}
MACHINES = {
    "FAKE": 0,
    "PSPM": 1,
    "WAPP": 2,
    "AOFTM": 3,
    "BPP": 4,
    "OOTY": 5,
    "SCAMP": 6,
    "GMRTFB": 7,
    "PULSAR2000": 8,
    "PARSPEC": 9,
    "BPSR": 10,
    "COBALT": 11,
    "GMRTNEW": 14,
    "CHIME": 20,
    "MWA-VCS": 30,
    "MWAX-VCS": 31,
    "MWAX-RTB": 32,
    "ADU": 40,
    "iTPM": 41,
}
DATA_TYPES = {
    "raw data": 0,
    "filterbank": 1,
    "time series": 2,
    "pulse profiles": 3,
    "amplitude spectrum": 4,
    "complex spectrum": 5,
    "dedispersed subbands": 6,
    "PSRFITS": 10,
}


def name_of(codes: dict[str, int], code: int, default: str) -> str:
    return next((k for k, v in codes.items() if v == code), default)


def parse_angle(packed: float, hours: bool = False) -> float:
    """Degrees of a packed HHMMSS.S (``hours``) or DDMMSS.S number."""
    sign, rest = (-1 if packed < 0 else 1), abs(packed)
    whole, minutes = divmod(rest, 10000)
    minutes, seconds = divmod(minutes, 100)
    return sign * (whole + minutes / 60 + seconds / 3600) * (15 if hours else 1)


def pack_angle(degrees: float, hours: bool = False) -> float:
    sign, rest = (-1 if degrees < 0 else 1), abs(degrees) / (15 if hours else 1)
    tenths = round(rest * 3600 * 10_000)
    whole, left = divmod(tenths, 36_000_000)
    minutes, left = divmod(left, 600_000)
    return sign * (whole * 10000 + minutes * 100 + left / 10_000)


def format_angle(degrees: float, hours: bool = False, digits: int = 4) -> str:
    packed = pack_angle(degrees, hours)
    whole, left = divmod(abs(packed), 10000)
    minutes, seconds = divmod(left, 100)
    return f"{'-' if packed < 0 else ''}{int(whole):02d}:{int(minutes):02d}:{seconds:0{3 + digits}.{digits}f}"


def mjd_to_datetime(mjd: float) -> datetime:
    return datetime(1858, 11, 17, tzinfo=UTC) + timedelta(days=mjd)


@dataclass(frozen=True)
class ObsHeader:
    nchans: int
    fch1: float
    foff: float
    tsamp: float
    nsamples: int = 0
    nbits: int = 32
    tstart: float = 50000.0
    nifs: int = 1
    data_type: str = "filterbank"
    source: str = ""
    telescope: str = "Fake"
    backend: str = "FAKE"
    ra: float = 0.0
    dec: float = 0.0
    azimuth: float = 0.0
    zenith: float = 0.0
    frame: str = "topocentric"
    ibeam: int = 0
    nbeams: int = 0
    dm: float = 0.0
    period: float = 0.0
    accel: float = 0.0
    signed: bool = False
    rawdatafile: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def bandwidth(self) -> float:
        return abs(self.foff) * self.nchans

    @property
    def ftop(self) -> float:
        return self.fch1 - self.foff / 2

    @property
    def fbottom(self) -> float:
        return self.ftop + self.foff * self.nchans

    @property
    def fcenter(self) -> float:
        return self.ftop + self.foff * self.nchans / 2

    @property
    def chan_freqs(self) -> np.ndarray:
        return np.arange(self.nchans) * self.foff + self.fch1

    @property
    def fmax(self) -> float:
        return float(self.chan_freqs.max())

    @property
    def fmin(self) -> float:
        return float(self.chan_freqs.min())

    @property
    def tobs(self) -> float:
        return self.tsamp * self.nsamples

    @property
    def obs_date(self) -> str:
        return mjd_to_datetime(self.tstart).strftime("%Y-%m-%dT%H:%M:%S.%f")

    def mjd_after(self, samples: int) -> float:
        return self.tstart + samples * self.tsamp / 86400

    def updated(self, **changes) -> ObsHeader:
        """A changed copy; unknown names are dropped."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    def reference(self, ref: str | float) -> float:
        if not isinstance(ref, str):
            return float(ref)
        named = {"fch1": self.fch1, "fmax": self.fmax, "fmin": self.fmin, "fcenter": self.fcenter}
        if ref not in named:
            raise ValueError(f"unknown reference frequency {ref!r}")
        return named[ref]

    def delays(self, dm: float | np.ndarray, ref: str | float = "fch1", in_samples: bool = True) -> np.ndarray:
        """Dispersion delay of each channel (for each DM, if an array), in samples rounded half to even or in seconds."""
        f, r = self.chan_freqs.astype(np.float32), np.float32(self.reference(ref))
        d = np.multiply.outer(np.atleast_1d(np.asarray(dm, np.float32)), np.float32(DM_CONSTANT) * (f**-2 - r**-2)).astype(np.float32)
        d = np.rint(d / np.float32(self.tsamp)).astype(np.int32) if in_samples else d
        return d[0] if np.ndim(dm) == 0 else d

    def smearing(self, dm: float, in_samples: bool = True) -> np.ndarray:
        """How far dispersion spreads a pulse within each channel."""
        s = 2 * DM_CONSTANT * abs(self.foff) * dm / self.chan_freqs**3
        return s / self.tsamp if in_samples else s

    def dedispersed(self, dm: float) -> ObsHeader:
        return self.updated(dm=dm, nchans=1, data_type="time series", nbits=32)

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "extra"}

    def to_string(self) -> str:
        rows = self.to_dict() | {"ra": format_angle(self.ra, True), "dec": format_angle(self.dec), "obs_date": self.obs_date, "bandwidth": self.bandwidth, "tobs": self.tobs}
        return "\n".join(f"{k:>12} : {v}" for k, v in rows.items())


# Scalar helpers.


def nearest_factor(n: int, target: int) -> int:
    """The divisor of ``n`` nearest to ``target``; of two as near, the smaller."""
    off, near = 0, max(1, min(n, target))
    while True:
        if near > off and n % (near - off) == 0:
            return near - off
        if n % (near + off) == 0:
            return near + off
        off += 1


def next_power_of_two(n: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(n)))) if n > 0 else 1


def next_multiple(n: int, of: int) -> int:
    return -(-n // of) * of


def duration_string(seconds: float) -> str:
    for size, name in ((86400, "days"), (3600, "hours"), (60, "minutes")):
        if seconds >= size:
            return f"{seconds / size:.1f} {name}"
    return f"{seconds:.1f} seconds"


def gaussian(x: np.ndarray, mean: float, fwhm: float, amplitude: float = 1.0) -> np.ndarray:
    sigma = fwhm / (2 * np.sqrt(2 * np.log(2)))
    return amplitude * np.exp(-((x - mean) ** 2) / (2 * sigma**2))


def pad_centre(x: np.ndarray, size: int) -> np.ndarray:
    """Zeros on both sides of the last axis."""
    before = (size - x.shape[-1]) // 2
    if before < 0 or size < x.shape[-1]:
        raise ValueError(f"cannot pad {x.shape[-1]} to {size}")
    return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(before, size - x.shape[-1] - before)])


def width_ladder(longest: int, factor: float = 1.5) -> list[int]:
    """Widths from 1, each ``factor`` times the last and larger by 1 at least."""
    if longest < 1 or factor <= 1:
        raise ValueError("the longest width must be positive and the factor above 1")
    out, w = [], 1
    while w <= longest:
        out.append(w)
        w = int(max(w + 1, factor * w))
    return out


def good_size(n: int, largest: int = 5) -> int:
    """The least number from ``n`` on without prime factors above ``largest`` (5 for real transforms, 11 for complex)."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11):
            while p <= largest and m % p == 0 and m > 1:
                m //= p
        if m <= 1:
            return max(n, 1)
        n += 1
