"""Periodicity search, cleaning of files and extraction of single pulses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import ObsHeader, good_size, next_multiple
from ..model import explode_spectra, pack_spectra
from ..operators import filterbank, folded, matched, rfi, series, spectrum


def periodicity(spectra: DataFrame, header: ObsHeader, dm: float, nfolds: int = 4, top: int = 10, window: float = 0.5) -> DataFrame:
    """``(obs_id, nfold, k, p, r, freq)``: the strongest bins of the whitened amplitude spectrum and its sums of harmonics."""
    tim = filterbank.dedisperse(spectra, header, dm)
    low, high = filterbank.valid_range(header.delays(dm), header.nsamples)
    head = header.dedispersed(dm).updated(nsamples=high - low)
    flat = series.deredden(tim.withColumn("t", F.col("t") - low), head, "mean", window)
    size = good_size(head.nsamples)
    padded = head.updated(nsamples=size)
    bins = size // 2 + 1
    white = spectrum.deredden(series.rfft(flat, size), padded, bins)
    # Every sum of harmonics reads the spectrum again: it is kept (memory and disk), and made again only where an executor is lost.
    sums = spectrum.harmonic_fold(spectrum.form_spec(white, True).persist(), bins, nfolds)
    peaks = spectrum.top_peaks(sums.where("k > 0"), top)
    return peaks.withColumn("freq", F.col("k") / F.lit(padded.tobs))


def fold_candidate(spectra: DataFrame, header: ObsHeader, period: float, dm: float, nbins: int = 50, nints: int = 32, nbands: int = 32) -> tuple[DataFrame, DataFrame]:
    """The centred cube of a candidate and its best profile signal-to-noise ratio."""
    # Small (a cell per sub-integration, band and bin) and read by the profile, its filter and the turn: made once.
    cube = folded.replace_nan(filterbank.fold(spectra, header, period, dm, 0.0, nbins, nints, nbands)).persist()
    turned = folded.centre(cube, nbins)
    snr = matched.best_pulse(matched.boxcar_snr(folded.profile(turned).withColumnRenamed("bin", "t"), nbins, nbins // 2))
    return turned, snr


def clean_file(spectra: DataFrame, header: ObsHeader, method: str = "mad", threshold: float = 3.0, freq_ranges=(), custom=None, value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned spectra and the mask."""
    cells, mask = rfi.clean(explode_spectra(spectra), header, method, threshold, freq_ranges, custom, value)
    return pack_spectra(cells), mask


@dataclass
class PulseWindow:
    """The samples around a pulse of ``width`` samples that arrives at ``toa`` in the reference frequency."""

    header: ObsHeader
    toa: int
    width: int
    dm: float
    min_nsamps: int = 256

    @property
    def decimate(self) -> int:
        return max(1, self.width // 2)

    @property
    def disp_delay(self) -> int:
        return int(np.abs(self.header.delays(self.dm)).max()) + 5 * self.width

    @property
    def nsamps(self) -> int:
        return max(2 * next_multiple(self.disp_delay, self.decimate), self.min_nsamps * self.decimate)

    @property
    def start(self) -> int:
        return self.toa - self.nsamps // 2

    def data(self, spectra: DataFrame, method: str = "median") -> DataFrame:
        """``fb`` of the window; samples outside of the file get each channel's median or mean within it."""
        inside = spectra.where(F.col("t").between(max(0, self.start), min(self.header.nsamples, self.start + self.nsamps) - 1))
        cells = explode_spectra(inside)
        level = cells.groupBy("obs_id", "c").agg((F.median("v") if method == "median" else F.avg("v")).alias("fill"))
        grid = level.select("obs_id", "c", "fill", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.nsamps - 1).cast("long"))).alias("t"))
        moved = cells.withColumn("t", F.col("t") - self.start)
        return grid.join(moved, ["obs_id", "c", "t"], "left").select("obs_id", "t", "c", F.coalesce("v", "fill").alias("v"))
