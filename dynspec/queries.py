"""The registered queries and their SQL.

The vectors of ``embeddings`` are a filterbank of 64 channels, ``vec_id`` the sample number; ``events`` are irregular samples. Floats are
rounded to 6 digits on both sides, as sums are made in another order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .meta import DM_CONSTANT, LIGHT_SPEED, ObsHeader, good_size, width_ladder
from .model import SYNTHETIC, embeddings_spectra, events_series, explode_spectra, pack_spectra
from .operators import filterbank as fbk
from .operators import folded, matched, rfi, robust, series, simulate, spectrum
from .plans import search
from .runtime import scratch, share_package
from .sources import masks, presto, sigproc
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FB = "fb AS (SELECT vec_id AS t, (i - 1)::INT AS c, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), h AS (SELECT count(*) AS n FROM embeddings)"
TS = FB + ", s AS (SELECT t, sum(v) AS v FROM fb GROUP BY t)"
DM, PERIOD, NBINS, NINTS, NBANDS = 50.0, 0.05, 8, 4, 4
DELAYS = SYNTHETIC.delays(DM).tolist()
LOW, HIGH = max(0, -min(DELAYS)), max(0, max(DELAYS))
D = f"({DELAYS}[c + 1])"
MASKED = [c % 7 == 3 for c in range(64)]


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(*embeddings_spectra(spark, sf_dir)))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Without ``obs_id`` where there is one record, doubles rounded."""
    kept = [c for c in df.columns if c != "obs_id"]
    kinds = dict(df.dtypes)
    return df.select(*[(C.tidy(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c)) for c in kept])


def r(x: str, name: str = "") -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def summed(spectra: DataFrame) -> DataFrame:
    return fbk.collapse(spectra)


# Samples and channels.


@query(f"WITH {FB} SELECT t, {r('sum(v)', 'v')} FROM fb GROUP BY t")
def collapse_sum(s, h):
    return fbk.collapse(s)


@query(f"WITH {FB} SELECT t, {r('avg(v)', 'v')} FROM fb GROUP BY t")
def collapse_mean(s, h):
    return fbk.collapse(s, "mean")


@query(f"WITH {FB} SELECT c, {r('sum(v)', 'v')} FROM fb GROUP BY c")
def bandpass_sum(s, h):
    return fbk.bandpass(explode_spectra(s))


@query(f"WITH {FB} SELECT c, {r('avg(v)', 'v')} FROM fb GROUP BY c")
def bandpass_mean(s, h):
    return fbk.bandpass(explode_spectra(s), "mean")


STATS = f"""{FB}, m AS (SELECT c, avg(v) AS m, var_pop(v) AS s2, count(*) AS n, min(v) AS lo, max(v) AS hi FROM fb GROUP BY c),
st AS (SELECT c, any_value(n) AS n, any_value(m) AS mean, any_value(s2) AS var, avg((v - m) ** 3) / any_value(s2) ** 1.5 AS skew, avg((v - m) ** 4) / any_value(s2) ** 2 - 3 AS kurt, any_value(lo) AS min, any_value(hi) AS max FROM fb JOIN m USING (c) GROUP BY c)"""


@query(f"WITH {STATS} SELECT c, n, {', '.join(r(x) for x in ('mean', 'var', 'skew', 'kurt', 'min', 'max'))} FROM st")
def chan_stats_full(s, h):
    return fbk.channel_stats(explode_spectra(s))


@query(f"WITH {STATS} SELECT c, n, {', '.join(r(x) for x in ('mean', 'var', 'min', 'max'))} FROM st")
def chan_stats_basic(s, h):
    return fbk.channel_stats(explode_spectra(s), "basic")


@query(ORACLE["chan_stats_full"])
def chan_stats_merged(s, h):
    cells = explode_spectra(s).withColumn("part", F.col("t") % 3)
    return fbk.merge_stats(fbk.partial_stats(cells, "part"))


@query("SELECT vec_id AS t, round(embedding[6]::DOUBLE, 6) + 0.0 AS v FROM embeddings")
def read_chan(s, h):
    return fbk.read_chan(s, h, 5)


@query(f"WITH {FB} SELECT t - 100 AS t, c - 8 AS c, {r('v')} FROM fb WHERE t BETWEEN 100 AND 299 AND c BETWEEN 8 AND 23")
def read_block(s, h):
    return explode_spectra(fbk.read_block(s, h, 100, 200, 1392.0, 16)[0])


@query(f"WITH {FB} SELECT t - {D} - 20 AS t, c, {r('v')} FROM fb WHERE t - {D} - 20 BETWEEN 0 AND 99")
def read_dedisp_block(s, h):
    return fbk.read_dedisp_block(explode_spectra(s), h, 20, 100, DM)


@query(f"WITH {FB}, g AS (SELECT g::INT AS gulp, i::INT AS i, 10 + g * 80 + i AS t FROM range(0, 5) a(g), range(0, 100) b(i) WHERE g * 80 + i < 400) SELECT gulp, i, t, {r('sum(v)', 'v')} FROM g JOIN fb USING (t) GROUP BY ALL")
def gulp_scan(s, h):
    return fbk.gulps(s, h, 100, 10, 400, 20).select("gulp", "i", "t", F.aggregate("spec", F.lit(0.0), lambda a, x: a + x).alias("v"))


@query(f"WITH {FB} SELECT t - 50 AS t, c, {r('v')} FROM fb WHERE t BETWEEN 50 AND 149")
def extract_samples(s, h):
    return explode_spectra(fbk.extract_samples(s, h, 50, 100)[0])


@query(f"WITH {FB} SELECT c, t, {r('v')} FROM fb WHERE c IN (1, 5, 40)")
def extract_chans(s, h):
    return fbk.extract_chans(s, h, [1, 5, 40])


@query(f"WITH {FB} SELECT ((c - 16) // 8)::INT AS band, t, ((c - 16) % 8)::INT AS c, {r('v')} FROM fb WHERE c BETWEEN 16 AND 47")
def extract_bands(s, h):
    return fbk.extract_bands(s, h, 16, 32, 8).select("band", "t", F.posexplode("spec").alias("c", "v"))


@query(f"WITH {FB} SELECT t, (63 - c)::INT AS c, {r('v')} FROM fb")
def invert_freq(s, h):
    return explode_spectra(fbk.invert_freq(s, h)[0])


@query(f"WITH {FB} SELECT t, c, CASE WHEN c % 7 = 3 THEN 0.0 ELSE round(v, 6) + 0.0 END AS v FROM fb")
def apply_channel_mask(s, h):
    return explode_spectra(fbk.apply_channel_mask(s, MASKED))


@query(f"WITH {FB} SELECT c, 1400.0 - c AS freq, (1400.0 - c BETWEEN 1380 AND 1390.5) OR (1400.0 - c BETWEEN 1340 AND 1340) AS \"user\" FROM fb WHERE t = 0")
def frequency_mask(s, h):
    return rfi.frequency_mask(rfi.channels(s.sparkSession, h), [(1380, 1390.5), (1340, 1340)])


TILES = f"WITH {FB} SELECT (t // 5)::BIGINT AS t, (c // 4)::INT AS c, round({{}}, 6) + 0.0 AS v FROM fb, h WHERE t < n // 5 * 5 GROUP BY 1, 2"


@query(TILES.format("avg(v)"))
def downsample_2d_mean(s, h):
    return fbk.downsample(explode_spectra(s), h, 5, 4)[0]


@query(TILES.format("median(v)"))
def downsample_2d_median(s, h):
    return fbk.downsample(explode_spectra(s), h, 5, 4, "median")[0]


@query(f"WITH {FB}, b AS (SELECT c, avg(v) AS bp FROM fb GROUP BY c), z AS (SELECT c, bp, bp / sum(bp) OVER () AS share FROM b), s AS (SELECT t, sum(v) AS total FROM fb GROUP BY t) SELECT t, c, {r('v - total * share + bp', 'v')} FROM fb JOIN z USING (c) JOIN s USING (t)")
def remove_zerodm(s, h):
    return fbk.remove_zerodm(explode_spectra(s))


QUANT = "least(255.0, greatest(0.0, ((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END) * (127.5 / 6) + 128.0))"


@query(f"WITH {FB}, m AS (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM fb GROUP BY c) SELECT t, c, floor({QUANT})::INT AS v FROM fb JOIN m USING (c)")
def quantize_8bit(s, h):
    return fbk.requantize(explode_spectra(s), 8)


LEVELS = "lv AS (SELECT t, c, (floor(abs(v) * 100))::BIGINT % 4 AS q FROM fb)"


def levels(s: DataFrame) -> DataFrame:
    return explode_spectra(s).select("obs_id", "t", "c", (F.floor(F.abs("v") * 100) % 4).cast("int").alias("q"))


@query(f"WITH {FB}, {LEVELS} SELECT t, (c // 4)::INT AS byte, sum(q << (6 - 2 * (c % 4)))::BIGINT AS v FROM lv GROUP BY 1, 2")
def pack_2bit(s, h):
    rows = levels(s).withColumn("byte", F.floor(F.col("c") / 4).cast("int"))
    return rows.groupBy("t", "byte").agg(C.packed(F.col("q"), F.col("c") % 4, 2).cast("long").alias("v"))


@query(f"WITH {FB}, {LEVELS} SELECT t, c, q::INT AS v FROM lv")
def unpack_2bit(s, h):
    made = pack_2bit(s, h)
    return made.select("t", "byte", F.posexplode(C.unpacked(F.col("v").cast("int"), 2)).alias("i", "v")).select("t", (F.col("byte") * 4 + F.col("i")).alias("c"), "v")


# Dispersion.

VALID = f"t - {D} BETWEEN {LOW} AND n - {HIGH} - 1"


@query(f"WITH {FB} SELECT t - {D} AS t, {r('sum(v)', 'v')} FROM fb, h WHERE {VALID} GROUP BY 1")
def dedisperse_dm50(s, h):
    return fbk.dedisperse(s, h, DM)


@query(f"WITH {FB} SELECT t - {D} AS t, (c // 8)::INT AS c, {r('sum(v)', 'v')} FROM fb, h WHERE {VALID} GROUP BY 1, 2")
def subband_dm50(s, h):
    return fbk.subband(s, h, DM, 8)[0]


@query(f"WITH {FB} SELECT ((t - {D}) % n + n) % n AS t, c, {r('v')} FROM fb, h")
def dedisperse_block(s, h):
    return fbk.dedisperse_block(explode_spectra(s), h, DM)


@query(f"WITH {FB} SELECT t - {D} AS t, c, {r('v')} FROM fb, h WHERE {VALID}")
def dedisperse_block_valid(s, h):
    return fbk.dedisperse_block(explode_spectra(s), h, DM, valid_only=True)


DMS = [0.0, 25.0, 50.0, 75.0, 100.0]
DMT = SYNTHETIC.delays(np.array(DMS)).tolist()


@query(f"WITH {FB}, g AS (SELECT unnest({DMS}) AS dm, unnest({DMT}) AS d) SELECT dm::DOUBLE AS dm, ((t - d[c + 1]) % n + n) % n AS t, {r('sum(v)', 'v')} FROM fb, g, h GROUP BY 1, 2")
def dmt_transform(s, h):
    return fbk.dmt_transform(s, h, DMS)


@query(f"WITH {FB}, g AS (SELECT unnest({DMS}) AS dm, unnest({DMT}) AS d) SELECT dm::DOUBLE AS dm, t - d[c + 1] AS t, {r('sum(v)', 'v')} FROM fb, g, h WHERE t - d[c + 1] BETWEEN 0 AND n - {max(map(max, DMT))} - 1 GROUP BY 1, 2")
def dmt_transform_valid(s, h):
    return fbk.dmt_transform(s, h, DMS, valid_only=True)


@query(f"WITH {FB} SELECT ((t + c * 3) % n)::BIGINT AS t, c, {r('v')} FROM fb, h")
def roll_channels(s, h):
    return fbk.roll(explode_spectra(s), [3 * c for c in range(64)], h.nsamples)


@query(f"WITH {FB} SELECT t + c * 3 - 100 AS t, c, {r('v')} FROM fb, h WHERE t + c * 3 - 100 BETWEEN 89 AND n - 101")
def roll_channels_valid(s, h):
    return fbk.roll(explode_spectra(s), [3 * c - 100 for c in range(64)], h.nsamples, valid_only=True)


@query("SELECT vec_id AS t, round(58543.0 + vec_id * 0.001 / 86400, 12) AS mjd FROM embeddings")
def sample_mjd(s, h):
    return s.select("t", F.round(C.mjd_after(h.tstart, F.col("t"), h.tsamp), 12).alias("mjd"))


# Angles are taken at whole seconds of arc, so that the packed form is exact.
ANGLE = "(vec_id * 611 % 648000 - 324000)"


@query(f"SELECT vec_id AS t, {r(f'sign({ANGLE}) * (abs({ANGLE}) // 3600 * 10000 + abs({ANGLE}) % 3600 // 60 * 100 + abs({ANGLE}) % 60)::DOUBLE', 'packed')}, {r(f'{ANGLE} / 3600.0', 'degrees')} FROM embeddings")
def packed_angles(s, h):
    degrees = (F.pmod(F.col("t") * 611, F.lit(648000)) - 324000) / 3600
    return s.select("t", C.packed_angle(degrees).alias("packed")).withColumn("degrees", C.angle_degrees(F.col("packed")))


@query(f"WITH {FB}, f AS (SELECT c, 1400.0 - c AS freq FROM fb WHERE t = 0) SELECT c, freq, round_even({DM_CONSTANT * DM} * (freq ** -2.0 - 1400.0 ** -2.0) / 0.001, 0)::INT AS delay FROM f")
def dm_delays(s, h):
    return rfi.channels(s.sparkSession, h).withColumn("delay", C.dm_delay(F.col("freq"), DM, h.fch1, h.tsamp))


@query(f"WITH {FB}, f AS (SELECT c, 1400.0 - c AS freq FROM fb WHERE t = 0) SELECT c, freq, {r(f'{2 * DM_CONSTANT * DM} / freq ** 3.0 / 0.001', 'smearing')} FROM f")
def dm_smearing(s, h):
    return rfi.channels(s.sparkSession, h).withColumn("smearing", C.dm_smearing(F.col("freq"), DM, h.foff, h.tsamp))


# Folding.

PHASE = f"{NBINS}.0 * (t * 0.001) / {PERIOD} + 0.5"
FOLDED = f"""{FB}, x AS (SELECT t - {D} AS t, c, v FROM fb, h WHERE {VALID}),
k AS (SELECT floor(t / (n / {NINTS}.0))::INT AS subint, (c // {64 // NBANDS})::INT AS band, (floor({PHASE})::BIGINT % {NBINS})::INT AS bin, v FROM x, h),
cube AS (SELECT subint, band, bin, avg(v) AS v, count(v) AS n FROM (SELECT a.i::INT AS subint, b.i::INT AS band, p.i::INT AS bin FROM range({NINTS}) a(i), range({NBANDS}) b(i), range({NBINS}) p(i)) LEFT JOIN k USING (subint, band, bin) GROUP BY ALL)"""


def cube_of(s: DataFrame, h: ObsHeader) -> DataFrame:
    return fbk.fold(s, h, PERIOD, DM, 0.0, NBINS, NINTS, NBANDS)


@query(f"WITH {FOLDED} SELECT subint, band, bin, {r('v')}, n FROM cube")
def fold_cube(s, h):
    return cube_of(s, h)


@query(f"WITH {TS}, k AS (SELECT floor(t / (n / {NINTS}.0))::INT AS subint, (floor({PHASE})::BIGINT % {NBINS})::INT AS bin, v FROM s, h), g AS (SELECT a.i::INT AS subint, p.i::INT AS bin FROM range({NINTS}) a(i), range({NBINS}) p(i)) SELECT subint, 0 AS band, bin, {r('avg(v)', 'v')}, count(v) AS n FROM g LEFT JOIN k USING (subint, bin) GROUP BY ALL")
def fold_series(s, h):
    return series.fold(summed(s), h, PERIOD, 0.0, NBINS, NINTS)


@query(f"WITH {FOLDED} SELECT bin, {r('sum(v)', 'v')} FROM cube GROUP BY bin")
def fold_profile(s, h):
    return folded.profile(cube_of(s, h))


@query(f"WITH {FOLDED} SELECT subint, band, bin, {r('sum(v)', 'v')} FROM cube GROUP BY GROUPING SETS ((bin), (subint, bin), (band, bin))")
def fold_grouping_sets(s, h):
    return folded.marginals(cube_of(s, h))


@query(f"WITH {FOLDED}, p AS (SELECT band, bin, sum(v) AS v FROM cube GROUP BY 1, 2) SELECT band, bin, {r('v / avg(v) OVER (PARTITION BY band)', 'v')} FROM p")
def fold_normalised(s, h):
    return folded.normalise_rows(folded.freq_phase(cube_of(s, h)), "band")


@query(f"WITH {FOLDED}, e AS (SELECT subint, band, bin, CASE WHEN bin = 2 THEN NULL ELSE v END AS v FROM cube) SELECT subint, band, bin, {r('coalesce(v, (SELECT median(v) FROM e))', 'v')} FROM e")
def fold_replace_nan(s, h):
    return folded.replace_nan(cube_of(s, h).withColumn("v", F.when(F.col("bin") != 2, F.col("v")))).drop("n")


BANDS = SYNTHETIC.updated(nchans=NBANDS, foff=-64.0 / NBANDS, fch1=1400.5 - 32.0 / NBANDS, tsamp=PERIOD / NBINS)
TUNED = BANDS.delays(150.0, 1400.0).tolist()


@query(f"WITH {FOLDED} SELECT subint, band, (((bin - {TUNED}[band + 1]) % {NBINS} + {NBINS}) % {NBINS})::INT AS bin, {r('v')}, n FROM cube")
def fold_update_dm(s, h):
    return folded.update_dm(cube_of(s, h), h.updated(period=PERIOD, dm=DM), 200.0, NBANDS, NBINS)


@query(f"WITH {FOLDED} SELECT subint, band, (((bin - round_even(subint * (((0.0502 / {PERIOD} - 1) * (0.001 * (SELECT n FROM h)) * {NBINS} / {PERIOD}) / {NINTS}), 0)::INT) % {NBINS} + {NBINS}) % {NBINS})::INT AS bin, {r('v')}, cube.n FROM cube")
def fold_update_period(s, h):
    return folded.update_period(cube_of(s, h), h.updated(period=PERIOD), 0.0502, NINTS, NBINS)


def turned_sql(cube: str) -> str:
    """SQL for ``turned``: the cells of the table ``cube``, their bins turned so that the middle of the best boxcar stands in the middle."""
    widths = width_ladder(NBINS // 2)
    return f"""pf AS (SELECT bin, sum(v) AS v FROM {cube} GROUP BY bin), pq AS (SELECT median(v) AS m, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {robust.IQR_NORMAL} AS sc FROM pf),
pz AS (SELECT bin, (v - m) / sc AS z FROM pf, pq), pw AS (SELECT unnest({list(range(len(widths)))}) AS itemp, unnest({widths}) AS width),
ps AS (SELECT itemp, width, a.bin, (sum(b.z) - width * (SELECT avg(z) FROM pz)) / sqrt(width * (1 - width / {NBINS}.0)) AS snr FROM pw, pz a JOIN pz b ON (b.bin - a.bin + {NBINS}) % {NBINS} < width GROUP BY itemp, width, a.bin),
pt AS (SELECT {NBINS // 2} - (bin + width // 2) AS turn FROM ps ORDER BY round(snr, 9) DESC, itemp, bin LIMIT 1),
turned AS (SELECT subint, band, ((bin + turn) % {NBINS} + {NBINS})::INT % {NBINS} AS bin, v, n FROM {cube}, pt)"""


@query(f"WITH {FOLDED}, {turned_sql('cube')} SELECT subint, band, bin::INT AS bin, {r('v')}, n FROM turned")
def fold_centre(s, h):
    return folded.centre(cube_of(s, h), NBINS)


@query(f"WITH {FOLDED} SELECT subint, band, bin, {r('v')}, n FROM cube WHERE subint = 2")
def subint_pick(s, h):
    return folded.get_subint(cube_of(s, h), 2)


@query(f"WITH {FOLDED} SELECT subint, band, bin, {r('v')}, n FROM cube WHERE band = 1")
def subband_pick(s, h):
    return folded.get_subband(cube_of(s, h), 1)


# Location and scale, of the variances of the channels or of each channel.

VARS = f"{FB}, x AS (SELECT c, var_pop(v) AS v FROM fb GROUP BY c)"
DEV = "med AS (SELECT median(v) AS m FROM x), dv AS (SELECT c, v, m, abs(v - m) AS d FROM x, med)"


def variances(s: DataFrame) -> DataFrame:
    return explode_spectra(s).groupBy("obs_id", "c").agg(F.var_pop("v").alias("v"))


def scale_query(name: str, sql: str) -> None:
    def f(s, h):
        return robust.scale(variances(s), ["obs_id"], name, order="c")

    f.__name__ = f"scale_{name}"
    query(sql)(f)


scale_query("std", f"WITH {VARS} SELECT {r('stddev_pop(v)', 'scale')} FROM x")
scale_query("iqr", f"WITH {VARS} SELECT {r(f'(quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {robust.IQR_NORMAL}', 'scale')} FROM x")
scale_query("mad", f"WITH {VARS}, {DEV} SELECT {r(f'median(d) / {robust.MAD_NORMAL}', 'scale')} FROM dv")
scale_query("doublemad", f"WITH {VARS}, {DEV} SELECT {r('max(m)', 'mid')}, {r(f'median(d) FILTER (v <= m) / {robust.MAD_NORMAL}', '\"left\"')}, {r(f'median(d) FILTER (v >= m) / {robust.MAD_NORMAL}', '\"right\"')} FROM dv")
scale_query("diffcov", f"WITH {VARS}, a AS (SELECT c, v - lag(v) OVER (ORDER BY c) AS d FROM x), b AS (SELECT d, lead(d) OVER (ORDER BY c) AS e FROM a) SELECT {r('sqrt(abs(covar_samp(d, e)))', 'scale')} FROM b WHERE d IS NOT NULL AND e IS NOT NULL")
scale_query("biweight", f"WITH {VARS}, {DEV}, w AS (SELECT v - m AS e, (v - m) / (9 * (SELECT median(d) FROM dv)) AS u FROM dv) SELECT round(sqrt((SELECT count(*) FROM w)) * sqrt(sum(e ** 2 * (1 - u ** 2) ** 4)) / abs(sum((1 - u ** 2) * (1 - 5 * u ** 2))), 6) + 0.0 AS scale FROM w WHERE abs(u) < 1")
scale_query("qn", f"WITH {VARS}, p AS (SELECT abs(a.v - b.v) AS d, row_number() OVER (ORDER BY abs(a.v - b.v)) AS k FROM x a JOIN x b ON a.c < b.c), q AS (SELECT count(*) // 2 + 1 AS h FROM x) SELECT {r(f'd / {robust.QN_NORMAL}', 'scale')} FROM p, q WHERE k = h * (h - 1) // 2")
scale_query("sn", f"WITH {VARS}, i AS (SELECT a.c, median(abs(a.v - b.v)) AS m FROM x a, x b GROUP BY a.c) SELECT {r('1.1926 * median(m)', 'scale')} FROM i")
scale_query("gapper", f"WITH {VARS}, g AS (SELECT row_number() OVER (ORDER BY v) AS i, lead(v) OVER (ORDER BY v) - v AS gap, count(*) OVER () AS n FROM x) SELECT {r(f'sum(i * (n - i) * gap) * {math.sqrt(math.pi)} / max(n * (n - 1))', 'scale')} FROM g")


@query(f"WITH {FB}, m AS (SELECT c, median(v) AS loc FROM fb GROUP BY c), s AS (SELECT c, loc, median(abs(v - loc)) / {robust.MAD_NORMAL} AS scale FROM fb JOIN m USING (c) GROUP BY ALL) SELECT c, t, {r('v')}, {r('loc')}, {r('scale')}, {r('(v - loc) / scale', 'z')} FROM fb JOIN s USING (c)")
def zscore_mad(s, h):
    return robust.zscore(explode_spectra(s), ["obs_id", "c"])


@query(f"WITH {FB}, s AS (SELECT c, avg(v) AS loc, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {robust.IQR_NORMAL} AS scale FROM fb GROUP BY c) SELECT c, t, {r('v')}, {r('loc')}, {r('scale')}, {r('(v - loc) / scale', 'z')} FROM fb JOIN s USING (c)")
def zscore_iqr(s, h):
    return robust.zscore(explode_spectra(s), ["obs_id", "c"], "mean", "iqr")


@query(f"WITH {FB}, m AS (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM fb GROUP BY c) SELECT c, t, {r('(v - m) / s', 'v')} FROM fb JOIN m USING (c)")
def normalise_channels(s, h):
    return robust.normalise(explode_spectra(s), ["obs_id", "c"])


# Interference.


def double_mad_sql(rows: str, value: str) -> str:
    """SQL for ``(c, masked)`` of a table's values."""
    return f"(SELECT c, abs(({value} - m) / CASE WHEN {value} < m THEN l ELSE g END) > 3 AS masked FROM {rows}, (SELECT m, median(abs({value} - m)) FILTER ({value} <= m) / {robust.MAD_NORMAL} AS l, median(abs({value} - m)) FILTER ({value} >= m) / {robust.MAD_NORMAL} AS g FROM {rows}, (SELECT median({value}) AS m FROM {rows}) GROUP BY m))"


@query(f"WITH {VARS}, f AS {double_mad_sql('x', 'v')} SELECT c, {r('v')}, masked FROM x JOIN f USING (c)")
def mask_double_mad(s, h):
    return rfi.double_mad_mask(variances(s))


@query(f"""WITH {VARS}, d AS (SELECT a.c, lag, a.v - b.v AS d FROM x a, (SELECT unnest(range(-5, 6)) AS lag) JOIN x b ON b.c = greatest(0, least(63, a.c - lag)) WHERE lag <> 0),
q AS (SELECT lag, median(d) AS m, (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) / {robust.IQR_NORMAL} AS s FROM d GROUP BY lag)
SELECT c, {r('any_value(v)', 'v')}, bool_or(abs((d - m) / s) > 3) AS masked FROM d JOIN q USING (lag) JOIN x USING (c) GROUP BY c""")
def mask_iqrm(s, h):
    return rfi.iqrm_mask(variances(s))


CLEAN = f"{STATS}, m1 AS {double_mad_sql('st', 'var')}, m2 AS {double_mad_sql('st', 'skew')}, m3 AS {double_mad_sql('st', 'kurt')}, mk AS (SELECT c, m1.masked OR m2.masked OR m3.masked OR 1400.0 - c BETWEEN 1380 AND 1385 AS masked FROM m1 JOIN m2 USING (c) JOIN m3 USING (c))"


@query(f"WITH {CLEAN} SELECT t, c, {r('CASE WHEN masked THEN (SELECT median(mean) FROM st JOIN mk USING (c) WHERE NOT masked) ELSE v END', 'v')} FROM fb JOIN mk USING (c)")
def clean_rfi(s, h):
    return rfi.clean(explode_spectra(s), h, freq_ranges=[(1380, 1385)])[0]


@query(f"WITH {CLEAN} SELECT count(*) FILTER (masked) AS num_masked, {r('100.0 * count(*) FILTER (masked) / count(*)', 'masked_fraction')} FROM mk")
def mask_fraction(s, h):
    return rfi.masked_fraction(rfi.rfi_mask(explode_spectra(s), h, freq_ranges=[(1380, 1385)]))


# Series.


def reflected(before: int, after: int, agg: str, rows: str = "s") -> str:
    """SQL for ``(t, v)``: an aggregate over the frame, the ends reflected."""
    return f"SELECT a.t, {agg} AS v FROM (SELECT t FROM {rows}) a, (SELECT unnest(range({-before}, {after + 1})) AS o), (SELECT count(*) AS nn FROM {rows}) JOIN {rows} b ON b.t = CASE WHEN a.t + o < 0 THEN -1 - a.t - o WHEN a.t + o >= nn THEN 2 * nn - 1 - a.t - o ELSE a.t + o END GROUP BY a.t"


@query(f"WITH {TS}, f AS ({reflected(5, 5, 'avg(b.v)')}) SELECT t, {r('v')} FROM f")
def running_mean(s, h):
    return series.running_filter(summed(s), h.nsamples, 11)


@query(f"WITH {TS}, f AS ({reflected(4, 3, 'median(b.v)')}) SELECT t, {r('v')} FROM f")
def running_median(s, h):
    return series.running_filter(summed(s), h.nsamples, 8, "median")


@query(f"""WITH {TS}, k AS (SELECT t // 3 AS t, avg(v) AS v FROM s, h WHERE t < n // 3 * 3 GROUP BY 1), f AS ({reflected(5, 5, 'avg(b.v)', 'k')}),
a AS (SELECT t, (t - 1) / 3.0 AS x, (SELECT max(t) FROM k) AS m FROM s), b AS (SELECT t, greatest(0, least(m, floor(x))) AS lo, greatest(0, least(m, floor(x) + 1)) AS hi, x - floor(x) AS p FROM a)
SELECT b.t, {r('l.v + (g.v - l.v) * p', 'v')} FROM b JOIN f l ON l.t = lo JOIN f g ON g.t = hi""")
def running_filter_fast(s, h):
    return series.running_filter_fast(summed(s), h.nsamples, 33, "mean", 11)


@query(f"WITH {TS}, f AS ({reflected(10, 10, 'avg(b.v)')}) SELECT t, {r('s.v - f.v', 'v')} FROM s JOIN f USING (t)")
def deredden_mean(s, h):
    return series.deredden(summed(s), h, "mean", 0.021)


@query(f"WITH {TS}, f AS ({reflected(3, 3, 'avg(b.v)')}) SELECT ((t - 3) % n + n) % n AS t, {r(f'v * {7**0.5}', 'v')} FROM f, h")
def apply_boxcar(s, h):
    return series.apply_boxcar(summed(s), h.nsamples, 7)


@query(f"WITH {FB}, f AS (SELECT c, regr_slope(v, t) AS m, avg(v) AS y, avg(t) AS x FROM fb GROUP BY c) SELECT c, t, {r('v - y - m * (t - x)', 'v')} FROM fb JOIN f USING (c)")
def detrend_linear(s, h):
    return series.detrend(explode_spectra(s), ["obs_id", "c"])


@query(f"WITH {TS} SELECT t // 7 AS t, {r('avg(v)', 'v')} FROM s, h WHERE t < n // 7 * 7 GROUP BY 1")
def ts_downsample(s, h):
    return series.downsample(summed(s), h.nsamples, 7)


@query(f"WITH {TS} SELECT t // 6 AS t, {r('median(v)', 'v')} FROM s, h WHERE t < n // 6 * 6 GROUP BY 1")
def ts_downsample_median(s, h):
    return series.downsample(summed(s), h.nsamples, 6, "median")


@query(f"WITH {TS}, g AS (SELECT unnest(range(0, n + 10)) AS t FROM h) SELECT g.t, {r('coalesce(s.v, (SELECT median(v) FROM s))', 'v')} FROM g LEFT JOIN s ON s.t = g.t - 4")
def ts_pad(s, h):
    return series.pad(summed(s), h.nsamples, h.nsamples + 10, "median", 4)


ACCEL = 2.0e8
P = ACCEL * 0.001 / (2 * LIGHT_SPEED)


@query(f"""WITH {TS}, x AS (SELECT t, v, n - 1 AS m FROM s, h WHERE t < n - 1),
y AS (SELECT t, v, m, trunc(t + {P!r} * ((t::DOUBLE - m // 2) * (t::DOUBLE - m // 2)) - {P!r} * ((m // 2) * (m // 2)))::BIGINT AS p FROM x),
z AS (SELECT *, coalesce(lag(p) OVER (ORDER BY t), 0) AS q FROM y),
w AS (SELECT p, t, 0 AS g, v, m FROM z UNION ALL SELECT p - 1, t, 1, v, m FROM z WHERE p - q > 1),
b AS (SELECT p, arg_max(v, t * 2 + g) AS v FROM w WHERE p BETWEEN 0 AND m - 1 GROUP BY p)
SELECT x.t, {r('coalesce(b.v, 0.0)', 'v')} FROM x LEFT JOIN b ON b.p = x.t""")
def ts_resample_accel(s, h):
    return series.resample(summed(s), h, ACCEL)


@query(f"WITH {TS}, o AS (SELECT t, v FROM fb WHERE c = 5) SELECT s.t - o.t AS lag, {r('sum(s.v * o.v)', 'v')} FROM s, o GROUP BY 1")
def ts_correlate(s, h):
    return series.correlate(summed(s), fbk.read_chan(s, h, 5))


# Spectra, of the series filled with zeros to the next length without prime factors above 5.

SIZE = "z AS (SELECT min(2.0 ** a * 3.0 ** b * 5.0 ** c)::BIGINT AS z FROM range(0, 24) x(a), range(0, 15) y(b), range(0, 11) w(c), h WHERE 2 ** a * 3 ** b * 5 ** c >= n), kk AS (SELECT z, z // 2 + 1 AS bins FROM z)"
DFT = f"{TS}, {SIZE}, ks AS (SELECT unnest(range(0, bins)) AS k, z FROM kk), ft AS (SELECT k, sum(v * cos(2 * pi() * ((k * t) % z) / z)) AS re, -sum(v * sin(2 * pi() * ((k * t) % z) / z)) AS im FROM s, ks GROUP BY k)"


def transformed(s: DataFrame) -> DataFrame:
    return series.rfft(summed(s))


def padded(h: ObsHeader) -> ObsHeader:
    return h.updated(nsamples=good_size(h.nsamples))


def bins_of(h: ObsHeader) -> int:
    return good_size(h.nsamples) // 2 + 1


@query(f"WITH {DFT} SELECT k, {r('re')}, {r('im')} FROM ft")
def rfft_series(s, h):
    return transformed(s)


@query(f"WITH {DFT} SELECT 0 AS nfold, k, {r('sqrt(re * re + im * im)', 'p')} FROM ft")
def rfft_spectrum(s, h):
    return spectrum.form_spec(transformed(s))


@query(f"WITH {DFT}, l AS (SELECT *, re - lag(re, 1, 0.0) OVER (ORDER BY k) AS a, im - lag(im, 1, 0.0) OVER (ORDER BY k) AS b FROM ft) SELECT 0 AS nfold, k, {r('sqrt(greatest(re * re + im * im, (a * a + b * b) / 2))', 'p')} FROM l")
def form_spec_interp(s, h):
    return spectrum.form_spec(transformed(s), True)


@query(f"WITH {TS}, {SIZE}, g AS (SELECT unnest(range(0, z)) AS t FROM z) SELECT g.t, {r('coalesce(s.v, 0.0)', 'v')} FROM g LEFT JOIN s USING (t)")
def ifft_round_trip(s, h):
    return spectrum.ifft(transformed(s), padded(h).nsamples)


@query(f"WITH {DFT} SELECT k, {r('re * re - im * im', 're')}, {r('2 * re * im', 'im')} FROM ft")
def fourier_multiply(s, h):
    f = transformed(s)
    return spectrum.multiply(f, f)


@query(f"""WITH {DFT}, p AS (SELECT k, sqrt(re * re + im * im) AS p FROM ft), fo AS (SELECT f, (2 ** (f + 1))::BIGINT AS nh FROM range(0, 3) t(f)),
tm AS (SELECT f, k AS i, (m + nh // 2) // nh + m * ((k - 1) // nh) + m * ((k - 1) % nh) // nh AS j FROM fo, p, kk, range(1, 8, 2) o(m) WHERE m < nh AND k BETWEEN 1 AND (bins - 1) // nh * nh),
a AS (SELECT f, i, sum(p) AS q FROM tm JOIN p ON p.k = j GROUP BY 1, 2)
SELECT nf::INT AS nfold, p.k, {r('any_value(p.p) + coalesce(sum(q), 0)', 'p')} FROM p CROSS JOIN range(0, 4) n(nf) LEFT JOIN a ON a.i = p.k AND a.f < nf GROUP BY 1, 2""")
def harmonic_fold(s, h):
    return spectrum.harmonic_fold(spectrum.form_spec(transformed(s)), bins_of(h), 3)


@query(f"""WITH RECURSIVE {DFT}, bl AS (SELECT 0 AS b, 1::BIGINT AS f, least(6, bins - 1)::BIGINT AS n, bins, z FROM kk UNION ALL
SELECT b + 1, f + n, least(bins - f - n, CASE WHEN b = 0 OR f + n < round_even(60 * 0.001 * z, 0) THEN greatest(1, round_even(6 * ln(f + n), 0)) ELSE 100 END)::BIGINT, bins, z FROM bl WHERE f + n < bins),
x AS (SELECT b, f, n, k, re, im, re * re + im * im AS w FROM ft JOIN bl ON k BETWEEN f AND f + n - 1),
m AS (SELECT b, n, median(w) / {math.log(2)!r} AS m FROM x GROUP BY b, n), y AS (SELECT b, m AS m0, n AS n0, lead(m) OVER (ORDER BY b) AS m1, lead(n) OVER (ORDER BY b) AS n1 FROM m),
g AS (SELECT k, re, im, 1 / sqrt(m0 + coalesce((m1 - m0) / (n0 + n1) * ((n0 + n1) / 2.0 - (k - f)), 0)) AS g FROM x JOIN y USING (b))
SELECT k, {r('re * g', 're')}, {r('im * g', 'im')} FROM g UNION ALL SELECT 0, 1.0, 0.0""")
def fourier_deredden(s, h):
    return spectrum.deredden(transformed(s), padded(h), bins_of(h), 6, 100, 60.0)


@query(f"WITH {DFT} SELECT k, {r('k / (0.001 * z)', 'freq')}, {r('0.001 * z / nullif(k, 0)', 'period')}, k AS bin FROM ft, z")
def bin_conversions(s, h):
    tobs = padded(h).tobs
    f = C.bin_to_freq(F.col("k"), tobs)
    return transformed(s).select("k", f.alias("freq"), C.bin_to_period(F.col("k"), tobs).alias("period"), C.freq_to_bin(f, tobs).alias("bin"))


@query(f"WITH {DFT}, p AS (SELECT k, sqrt(re * re + im * im) AS p FROM ft) SELECT 0 AS nfold, k, {r('p')}, row_number() OVER (ORDER BY p DESC, k)::INT AS r FROM p QUALIFY r <= 10")
def spectrum_top(s, h):
    return spectrum.top_peaks(spectrum.form_spec(transformed(s)))


@query(f"""WITH {DFT}, hs AS (SELECT j, re, im FROM range(1, 9) t(j), z JOIN ft ON k = round_even(12.0 * (0.001 * z) * j, 0)), bs AS (SELECT unnest(range(0, 16)) AS bin)
SELECT bin::INT AS bin, round(sqrt(sum(CASE WHEN j < 8 THEN 2 * (re * cos(2 * pi() * j * bin / 16) - im * sin(2 * pi() * j * bin / 16)) ELSE re * cos(pi() * bin) END) ** 2 + sum(CASE WHEN j = 8 THEN im * cos(pi() * bin) ELSE 0 END) ** 2) / 16, 6) + 0.0 AS v FROM hs, bs GROUP BY bin""")
def recon_profile(s, h):
    return spectrum.recon_prof(transformed(s), padded(h), 12.0, 8)


# Pulses.

WIDTHS = width_ladder(32)
SNR = f"""{TS}, q AS (SELECT median(v) AS m, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / {robust.IQR_NORMAL} AS sc FROM s), z AS (SELECT t, (v - m) / sc AS z FROM s, q), zm AS (SELECT avg(z) AS zm FROM z),
zz AS (SELECT t, z FROM z UNION ALL SELECT t + n, z FROM z, h WHERE t < 31), cs AS (SELECT t, sum(z) OVER (ORDER BY t) AS e, sum(z) OVER (ORDER BY t) - z AS a FROM zz),
wd AS (SELECT unnest({list(range(len(WIDTHS)))}) AS itemp, unnest({WIDTHS}) AS width),
snr AS (SELECT itemp, width, a.t, (b.e - a.a - width * zm) / sqrt(width * (1 - width / n::DOUBLE)) AS snr FROM wd, zm, h, cs a JOIN cs b ON b.t = a.t + width - 1 WHERE a.t < n)"""


@query(f"WITH {SNR} SELECT itemp::INT AS itemp, width::INT AS width, t, {r('snr')} FROM snr")
def matched_filter_boxcar(s, h):
    return matched.boxcar_snr(summed(s), h.nsamples)


@query(f"WITH {SNR} SELECT itemp::INT AS itemp, width::INT AS width, t AS peak_bin, {r('snr')} FROM snr ORDER BY snr DESC, itemp, t LIMIT 1")
def best_pulse(s, h):
    return matched.best_pulse(matched.boxcar_snr(summed(s), h.nsamples))


BEST = "bp AS (SELECT itemp, width, t AS peak_bin, snr FROM snr ORDER BY snr DESC, itemp, t LIMIT 1)"


@query(f"WITH {SNR}, {BEST} SELECT itemp::INT AS itemp, width::INT AS width, peak_bin, {r('snr')}, greatest(0, peak_bin)::BIGINT AS on_start, least(n, peak_bin + width)::BIGINT AS on_end FROM bp, h")
def on_pulse(s, h):
    return matched.on_pulse(matched.best_pulse(matched.boxcar_snr(summed(s), h.nsamples)), "boxcar", h.nsamples)


@query(f"WITH {SNR}, {BEST} SELECT t, round(((CASE WHEN ((t - peak_bin) % n + n) % n < width THEN 1 ELSE 0 END) - width / n::DOUBLE) / sqrt(width * (1 - width / n::DOUBLE)), 6) + 0.0 AS v FROM (SELECT unnest(range(0, n)) AS t FROM h), bp, h")
def best_model(s, h):
    return matched.best_model(matched.best_pulse(matched.boxcar_snr(summed(s), h.nsamples)), "boxcar", h.nsamples)


@query(f"WITH {FB}, a AS (SELECT t, v FROM fb WHERE c = 5), b AS (SELECT t, v FROM fb WHERE c = 9 AND t < 40) SELECT a.t + b.t AS t, {r('sum(a.v * b.v)', 'v')} FROM a, b GROUP BY 1")
def ts_convolve(s, h):
    return matched.convolve_series(fbk.read_chan(s, h, 5), fbk.read_chan(s, h, 9).where("t < 40"))


@query(f"WITH {FB}, l AS (SELECT c, median(v) AS fill FROM fb GROUP BY c), g AS (SELECT unnest(range(0, n + 20)) AS t FROM h) SELECT g.t, l.c, {r('coalesce(fb.v, fill)', 'v')} FROM g CROSS JOIN l LEFT JOIN fb ON fb.t = g.t - 7 AND fb.c = l.c")
def block_pad(s, h):
    return fbk.pad_samples(explode_spectra(s), h.nsamples, h.nsamples + 20, 7)


def template_sql(kind: str, widest: float) -> str:
    """SQL for the correlations with a bank of templates, given by their samples."""
    bank = [(i, width, j - ref, float(v)) for i, (width, shape, ref) in enumerate(matched.templates(kind, widest)) for j, v in enumerate(shape)]
    rows = ", ".join(f"({i}, {w!r}, {o}, {v!r})" for i, w, o, v in bank)
    return f"""{SNR}, tp(i, w, o, x) AS (VALUES {rows}), tm AS (SELECT i, sum(x::DOUBLE) AS sx, sum(x::DOUBLE ** 2) AS sxx FROM tp GROUP BY i),
cr AS (SELECT i, any_value(w) AS w, a.t, sum(x::DOUBLE * b.z) AS s FROM z a, tp, h JOIN z b ON b.t = ((a.t + o) % n + n) % n GROUP BY i, a.t)
SELECT i::INT AS itemp, {r('w::DOUBLE', 'width')}, t, {r('(s - sx / n * (zm * n)) / sqrt(sxx - sx * sx / n)', 'snr')} FROM cr JOIN tm USING (i), zm, h"""


@query("WITH " + template_sql("gaussian", 32))
def matched_filter_gaussian(s, h):
    return matched.matched_filter(summed(s), "gaussian")


@query("WITH " + template_sql("lorentzian", 16))
def matched_filter_lorentzian(s, h):
    return matched.matched_filter(summed(s), "lorentzian", 16)


# The dedispersed series less its running mean takes the place of ``s``, its length that of ``h``; the rest as above with the defaults of the plan.
FLAT = f"{FB.replace('h AS', 'h0 AS')}, s0 AS (SELECT t - {D} - {LOW} AS t, sum(v) AS v FROM fb, h0 WHERE {VALID.replace('n -', 'h0.n -')} GROUP BY 1), h AS (SELECT count(*) AS n FROM s0), f0 AS ({reflected(50, 49, 'avg(b.v)', 's0')}), s AS (SELECT t, s0.v - f0.v AS v FROM s0 JOIN f0 USING (t))"


@query(f"""WITH RECURSIVE {DFT.replace(TS, FLAT)}, bl AS (SELECT 0 AS b, 1::BIGINT AS f, least(6, bins - 1)::BIGINT AS n, bins, z FROM kk UNION ALL
SELECT b + 1, f + n, least(bins - f - n, CASE WHEN b = 0 OR f + n < round_even(6 * 0.001 * z, 0) THEN greatest(1, round_even(6 * ln(f + n), 0)) ELSE 100 END)::BIGINT, bins, z FROM bl WHERE f + n < bins),
x AS (SELECT b, f, n, k, re, im, re * re + im * im AS w FROM ft JOIN bl ON k BETWEEN f AND f + n - 1),
m AS (SELECT b, n, median(w) / {math.log(2)!r} AS m FROM x GROUP BY b, n), y AS (SELECT b, m AS m0, n AS n0, lead(m) OVER (ORDER BY b) AS m1, lead(n) OVER (ORDER BY b) AS n1 FROM m),
g AS (SELECT k, re, im, 1 / sqrt(m0 + coalesce((m1 - m0) / (n0 + n1) * ((n0 + n1) / 2.0 - (k - f)), 0)) AS g FROM x JOIN y USING (b)),
wh AS (SELECT k, re * g AS re, im * g AS im FROM g UNION ALL SELECT 0, 1.0, 0.0), l AS (SELECT *, re - lag(re, 1, 0.0) OVER (ORDER BY k) AS a, im - lag(im, 1, 0.0) OVER (ORDER BY k) AS b FROM wh),
p AS (SELECT k, sqrt(greatest(re * re + im * im, (a * a + b * b) / 2)) AS p FROM l), fo AS (SELECT f, (2 ** (f + 1))::BIGINT AS nh FROM range(0, 3) t(f)),
tm AS (SELECT f, k AS i, (o.m + nh // 2) // nh + o.m * ((k - 1) // nh) + o.m * ((k - 1) % nh) // nh AS j FROM fo, p, kk, range(1, 8, 2) o(m) WHERE o.m < nh AND k BETWEEN 1 AND (bins - 1) // nh * nh),
ha AS (SELECT f, i, sum(p) AS q FROM tm JOIN p ON p.k = j GROUP BY 1, 2),
hf AS (SELECT nf::INT AS nfold, p.k, any_value(p.p) + coalesce(sum(q), 0) AS p FROM p CROSS JOIN range(0, 4) n(nf) LEFT JOIN ha ON ha.i = p.k AND ha.f < nf WHERE p.k > 0 GROUP BY 1, 2)
SELECT nfold, k, {r('p')}, row_number() OVER (PARTITION BY nfold ORDER BY p DESC, k)::INT AS r, {r('k / (0.001 * z)', 'freq')} FROM hf, z QUALIFY r <= 5""")
def periodicity_search(s, h):
    return search.periodicity(s, h, DM, 3, 5, 0.1)


@query(f"WITH {FOLDED}, filled AS (SELECT subint, band, bin, coalesce(v, (SELECT median(v) FROM cube)) AS v, n FROM cube), {turned_sql('filled')} SELECT subint, band, bin::INT AS bin, {r('v')}, n FROM turned")
def fold_candidate(s, h):
    return search.fold_candidate(s, h, PERIOD, DM, NBINS, NINTS, NBANDS)[0]


@query(f"""WITH {FB}, w AS (SELECT t - 2 AS t, c, v FROM fb WHERE t BETWEEN 2 AND 257), l AS (SELECT c, median(v) AS fill FROM w GROUP BY c), g AS (SELECT unnest(range(0, 256)) AS t)
SELECT g.t, c, {r('coalesce(w.v, fill)', 'v')} FROM g CROSS JOIN l LEFT JOIN w USING (t, c)""")
def pulse_window(s, h):
    return search.PulseWindow(h, toa=130, width=2, dm=DM, min_nsamps=256).data(s)


BURST = simulate.PulseParams(dm=DM, snr=20.0, width_ms=4.0, structure="flat")
#: A flat burst is 64 equal Gaussians: its band sum has the length snr * sqrt(64), whatever their shape.
SIGMA = BURST.width_ms / 1000 / SYNTHETIC.tsamp / (2 * math.sqrt(2 * math.log(2)))


@query(f"""WITH g AS (SELECT t, c, exp(-((t - 128 - {DELAYS}[c + 1]) ** 2) / (2 * {SIGMA!r} ** 2)) AS p FROM range(0, 256) a(t), range(0, 64) b(c)),
k AS (SELECT {BURST.snr} * 8 / (64 * sqrt(sum(exp(-(o ** 2) / (2 * {SIGMA!r} ** 2)) ** 2))) AS k FROM range(-100, 101) x(o))
SELECT t, c::INT AS c, round(p * k, 6) + 0.0 AS v FROM g, k""")
def simulated_burst(s, h):
    return simulate.burst(s.sparkSession, h, BURST, 256)


@query(f"WITH {FB}, w AS (SELECT t, c, v, avg(v) OVER x AS m, stddev_pop(v) OVER x AS s FROM fb WINDOW x AS (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT t, c, {r('(v - m) / CASE WHEN s > 1e-5 THEN s ELSE 1 END', 'v')} FROM w")
def rescale_running(s, h):
    return windows.rescale(explode_spectra(s))


# Files: what is written is read back.


@query(f"WITH {FB} SELECT t, c, {r('v')} FROM fb")
def fil_round_trip(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".fil"
    sigproc.write_fil(s, h, path)
    return explode_spectra(sigproc.read_fil(s.sparkSession, path)[0])


@query(f"WITH {FB}, m AS (SELECT c, avg(v) AS m, stddev_pop(v) AS s FROM fb GROUP BY c) SELECT t, c, least(3.0, greatest(0.0, trunc(((v - m) / s) * (1.5 / 1.5) + 2.0)))::DOUBLE AS v FROM fb JOIN m USING (c)")
def fil_round_trip_2bit(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".fil"
    sigproc.write_fil(pack_spectra(fbk.requantize(explode_spectra(s), 2)), h.updated(nbits=2), path)
    return explode_spectra(sigproc.read_fil(s.sparkSession, path)[0])


@query("SELECT vec_id AS t, round(embedding[6]::DOUBLE, 6) + 0.0 AS v FROM embeddings")
def dat_round_trip(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".dat"
    presto.write_dat(fbk.read_chan(s, h, 5), h, path)
    return presto.read_dat(s.sparkSession, path)[0]


@query("SELECT vec_id AS k, round(embedding[1]::DOUBLE, 6) + 0.0 AS re, round(embedding[2]::DOUBLE, 6) + 0.0 AS im FROM embeddings")
def fft_round_trip(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".fft"
    pairs = s.select("obs_id", F.col("t").alias("k"), F.col("spec")[0].alias("re"), F.col("spec")[1].alias("im"))
    presto.write_fft(pairs, h, path)
    return presto.read_fft(s.sparkSession, path)[0]


@query(f"WITH {TS} SELECT t, round(v::FLOAT::DOUBLE, 3) + 0.0 AS v FROM s")
def tim_round_trip(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".tim"
    presto.write_tim(summed(s), h, path)
    return presto.read_tim(s.sparkSession, path)[0].withColumn("v", F.round("v", 3))


@query("SELECT vec_id AS k, round(embedding[3]::DOUBLE, 6) + 0.0 AS re, round(embedding[4]::DOUBLE, 6) + 0.0 AS im FROM embeddings")
def spec_round_trip(s, h):
    path = scratch(s.sparkSession, "round-trip") + ".spec"
    presto.write_spec(s.select("obs_id", F.col("t").alias("k"), F.col("spec")[2].alias("re"), F.col("spec")[3].alias("im")), h, path)
    return presto.read_spec(s.sparkSession, path)[0]


@query(f"WITH {FB} SELECT t - 33 AS t, c - 8 AS c, {r('v')} FROM fb WHERE t BETWEEN 33 AND 132 AND c BETWEEN 8 AND 23")
def fil_block(s, h):
    path = scratch(s.sparkSession, "block") + ".fil"
    sigproc.write_fil(s, h, path)
    return explode_spectra(sigproc.read_fil_block(s.sparkSession, path, 33, 100, 1392.0, 16)[0])


@query(ORACLE["simulated_burst"])
def burst_round_trip(s, h):
    path = scratch(s.sparkSession, "burst")
    masks.save(simulate.burst(s.sparkSession, h, BURST, 256), h, path, dm=BURST.dm)
    return masks.load(s.sparkSession, path)[0]


@query(f"WITH {CLEAN} SELECT c, masked FROM mk")
def mask_round_trip(s, h):
    path = scratch(s.sparkSession, "mask")
    masks.save(rfi.rfi_mask(explode_spectra(s), h, freq_ranges=[(1380, 1385)]).select("c", "masked"), h, path)
    return masks.load(s.sparkSession, path)[0]


# Events.


def events_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events_series(spark, sf_dir)
    return made.select("obs_id", "t", C.tidy(F.col("v")).alias("v"))


QUERIES["events_timeseries"] = events_timeseries
ORACLE["events_timeseries"] = f"""
WITH e AS (SELECT event_type AS obs_id, epoch_us(ts) // 3600000000 AS b, value FROM events), g AS (SELECT DISTINCT obs_id, unnest(range((SELECT min(b) FROM e), (SELECT max(b) FROM e) + 1)) AS b FROM e)
SELECT g.obs_id, g.b - (SELECT min(b) FROM e) AS t, {r('coalesce(sum(value), 0.0)', 'v')} FROM g LEFT JOIN e USING (obs_id, b) GROUP BY g.obs_id, g.b
"""


EVENT_WINDOWS = f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS "start", event_type, count(*) AS n, {r('sum(value)', 'total')}, {r('avg(value)', 'mean')}, {r('min(value)', 'low')}, {r('max(value)', 'high')} FROM events GROUP BY 1, 2"""


def _windows(df: DataFrame) -> DataFrame:
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", *[C.tidy(F.col(c)).alias(c) for c in ("total", "mean", "low", "high")])


def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return _windows(windows.windowed_stats(raw.withColumn("ts", F.col("ts").cast("timestamp"))))


def events_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, run until what is there is read."""
    share_package(spark)
    name = f"events_{scratch(spark, 'q').rsplit('-', 1)[1]}"
    # A pattern, so that the table may be a file or a folder of files.
    live = windows.windowed_stats(windows.read_events(spark, f"{sf_dir.rstrip('/')}/events.parque[t]"))
    q = live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return _windows(spark.table(name))


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    out = windows.session_stats(raw.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n", C.tidy(F.col("total")).alias("total"))


QUERIES |= {"events_windows": events_windows, "events_stream_windows": events_stream_windows, "events_sessions": events_sessions}
ORACLE |= {
    "events_windows": EVENT_WINDOWS,
    "events_stream_windows": EVENT_WINDOWS,
    "events_sessions": f"""WITH a AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, {r('sum(value)', 'total')} FROM b GROUP BY user_id, g""",
}
