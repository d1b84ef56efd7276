"""Column expressions for samples, frequencies, bits and complex numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import DM_CONSTANT

# Quantisation, by bits: the deviations that the digital range spans on one side.
DIGI_SIGMA = {1: 0.5, 2: 1.5, 4: 6.0, 8: 6.0, 16: 6.0}


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def quantized(z: Column, nbits: int) -> Column:
    """Digital level of a normalised value; clipped before the cast, which would overflow."""
    mean = 2 ** (nbits - 1) - 0.5
    scale = mean / DIGI_SIGMA[nbits]
    # Truncated toward zero first and clipped then, as levels below zero are.
    return F.least(F.lit(float(2**nbits - 1)), F.greatest(F.lit(0.0), z * scale + (mean + 0.5))).cast("int")


def dm_delay(freq: Column, dm: float, ref: float, tsamp: float) -> Column:
    """Delay in samples, half to even, in double precision."""
    return F.rint(F.lit(DM_CONSTANT * dm) * (F.pow(freq, F.lit(-2.0)) - F.lit(ref**-2)) / F.lit(tsamp)).cast("int")


def dm_smearing(freq: Column, dm: float, foff: float, tsamp: float) -> Column:
    return F.lit(2 * DM_CONSTANT * abs(foff) * dm) / F.pow(freq, F.lit(3.0)) / F.lit(tsamp)


def mjd_after(tstart: float, n: Column, tsamp: float) -> Column:
    return F.lit(tstart) + n * F.lit(tsamp / 86400)


def mjd_timestamp(mjd: Column) -> Column:
    return F.timestamp_micros(F.rint((mjd - 40587.0) * 86400e6).cast("long"))


def bin_to_freq(k: Column, tobs: float) -> Column:
    return k / F.lit(tobs)


def bin_to_period(k: Column, tobs: float) -> Column:
    """Null for bin 0."""
    return F.try_divide(F.lit(tobs), k)


def freq_to_bin(freq: Column, tobs: float) -> Column:
    return F.rint(freq * F.lit(tobs)).cast("long")


def period_to_bin(period: Column, tobs: float) -> Column:
    return F.rint(F.lit(tobs) / period).cast("long")


def amplitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def complex_product(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of ``a + ib`` and ``c + id``."""
    return a * c - b * d, a * d + b * c


def unpacked(byte: Column, nbits: int, big: bool = True) -> Column:
    """The ``8 / nbits`` samples of a byte, first the highest bits (``big``) or the lowest."""
    n = 8 // nbits
    shifts = [8 - nbits * (i + 1) if big else nbits * i for i in range(n)]
    return F.array(*[F.shiftright(byte, s).bitwiseAND(2**nbits - 1) for s in shifts])


def packed(samples: Column, place: Column, nbits: int, big: bool = True) -> Column:
    """Aggregate of a byte's samples into the byte; ``place`` is the sample's place within it."""
    n = 8 // nbits
    shift = (F.lit(n - 1) - place) * nbits if big else place * nbits
    return F.bit_or(F.call_function("shiftleft", samples.cast("int"), shift.cast("int")))


def packed_angle(degrees: Column, hours: bool = False) -> Column:
    """HHMMSS.S (``hours``) or DDMMSS.S of an angle."""
    total = F.round(F.abs(degrees) / (15.0 if hours else 1.0) * 3600, 4)
    whole = F.floor(total / 3600)
    minutes = F.floor((total - whole * 3600) / 60)
    return F.signum(degrees) * (whole * 10000 + minutes * 100 + (total - whole * 3600 - minutes * 60))


def angle_degrees(packed_value: Column, hours: bool = False) -> Column:
    a = F.abs(packed_value)
    whole, minutes = F.floor(a / 10000), F.floor(F.pmod(a, F.lit(10000.0)) / 100)
    return F.signum(packed_value) * (whole + minutes / 60 + F.pmod(a, F.lit(100.0)) / 3600) * (15.0 if hours else 1.0)
