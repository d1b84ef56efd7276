"""Files: headers, packing, round trips, damage."""

import struct

import numpy as np
import pytest

from dynspec import cli
from dynspec.meta import ObsHeader
from dynspec.operators import filterbank
from dynspec.sources import bits, masks, presto, psrfits, sigproc

HEAD = ObsHeader(nchans=16, fch1=1500.0, foff=-1.0, tsamp=0.001, nsamples=100, nbits=8, tstart=58000.0, source="J0000+0000", telescope="Parkes", ra=83.63, dec=22.01)


def write_raw(path, head, x, **more):
    raw = sigproc.from_header(head) | more
    path.write_bytes(sigproc.encode_header(raw) + bits.encode(np.asarray(x).ravel(), head.nbits))
    return str(path)


@pytest.mark.parametrize("nbits", [1, 2, 4])
@pytest.mark.parametrize("order", ["big", "little"])
def test_bits_round_trip(nbits, order):
    x = np.random.default_rng(1).integers(0, 2**nbits, 64).astype(np.uint8)
    assert (bits.unpack(bits.pack(x, nbits, order), nbits, order) == x).all()
    assert bits.pack(np.array([1] + [0] * (8 // nbits - 1)), nbits, order)[0] == (1 << (8 - nbits) if order == "big" else 1)
    with pytest.raises(ValueError):
        bits.pack(x[:-1], nbits, order) if nbits < 8 and 8 // nbits > 1 else bits.unpack(x, 3)


def test_quantize_levels():
    assert bits.quantize(np.array([-100, 0, 100.0]), 8).tolist() == [0, 128, 255]
    assert bits.quantize(np.array([0.0]), 32).dtype == np.float32


@pytest.mark.parametrize("nbits", [1, 2, 4, 8, 16, 32])
def test_fil_read(spark, tmp_path, nbits):
    x = np.random.default_rng(nbits).integers(0, 2 ** min(nbits, 8), (100, 16))
    path = write_raw(tmp_path / "a.fil", HEAD.updated(nbits=nbits), x)
    df, head = sigproc.read_fil(spark, path, chunk=33)
    got = np.array([r.spec for r in df.orderBy("t").collect()])
    assert (got == x).all() and head.nsamples == 100 and head.telescope == "Parkes" and head.ra == pytest.approx(83.63, abs=1e-4)
    part, _ = sigproc.read_fil(spark, path, chunk=8, start=10, nsamps=20)
    assert [r.t for r in part.orderBy("t").collect()] == list(range(10, 30))


def test_fil_stream_of_files(spark, tmp_path):
    x = np.arange(100 * 16).reshape(100, 16) % 256
    a = write_raw(tmp_path / "a.fil", HEAD, x[:60])
    b = write_raw(tmp_path / "b.fil", HEAD.updated(tstart=HEAD.mjd_after(60)), x[60:])
    df, head = sigproc.read_fil(spark, [a, b], chunk=25)
    assert (np.array([r.spec for r in df.orderBy("t").collect()]) == x).all() and head.nsamples == 100
    late = write_raw(tmp_path / "c.fil", HEAD.updated(tstart=HEAD.mjd_after(99)), x[60:])
    with pytest.raises(ValueError, match="follow"):
        sigproc.read_header([a, late])
    assert sigproc.read_header([a, late], contiguous=False).nsamples == 100
    other = write_raw(tmp_path / "d.fil", HEAD.updated(foff=-2.0), x)
    with pytest.raises(ValueError, match="differ"):
        sigproc.read_header([a, other])


@pytest.mark.parametrize("nbits", [2, 8, 32])
def test_fil_write(spark, tmp_path, nbits):
    x = np.random.default_rng(3).integers(0, 2 ** min(nbits, 8), (100, 16))
    a = write_raw(tmp_path / "a.fil", HEAD.updated(nbits=nbits), x)
    df, head = sigproc.read_fil(spark, a, chunk=17)
    sigproc.write_fil(df.repartition(5), head, str(tmp_path / "b.fil"))
    assert (tmp_path / "b.fil").read_bytes() == (tmp_path / "a.fil").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.fil", "b.fil"]


def test_header_faults(tmp_path):
    good = sigproc.encode_header(sigproc.from_header(HEAD))
    assert sigproc.parse_header_bytes(good)["nchans"] == 16
    for bad in (b"", good[:20], struct.pack("<I", 5) + b"WRONG" + good, good[:-16] + struct.pack("<I", 99999) + b"x"):
        with pytest.raises(ValueError):
            sigproc.parse_header_bytes(bad)
    start = sigproc._text("HEADER_START")
    for size in (1, 4, 8):
        odd = start + sigproc._text("mystery") + b"\x07" * size + good[len(start) :]
        assert sigproc.parse_header_bytes(odd)["nchans"] == 16


def test_header_edit(tmp_path):
    path = write_raw(tmp_path / "a.fil", HEAD, np.zeros((10, 16)))
    sigproc.edit_header(path, "source_name", "X")
    sigproc.edit_header(path, "tsamp", 0.5)
    h = sigproc.parse_header(path)
    assert h["source_name"].strip() == "X" and h["tsamp"] == 0.5 and h["nsamples"] == 10
    with pytest.raises(ValueError):
        sigproc.edit_header(path, "nonsense", 1)


def test_series_files(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=1000).astype(np.float32)
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "obs_id string, t long, v double")
    head = HEAD.updated(nchans=1, nsamples=1000, dm=12.5)
    presto.write_dat(s, head, str(tmp_path / "a.dat"))
    presto.write_tim(s, head, str(tmp_path / "a.tim"))
    for df, h in (presto.read_dat(spark, str(tmp_path / "a.dat")), presto.read_tim(spark, str(tmp_path / "a.tim"))):
        assert [r.v for r in df.orderBy("t").collect()] == x.astype(float).tolist()
        assert h.nsamples == 1000 and h.tsamp == 0.001 and h.dm == 12.5
    f = spark.createDataFrame([("a", i, float(x[2 * i]), float(x[2 * i + 1])) for i in range(500)], "obs_id string, k long, re double, im double")
    presto.write_fft(f, head, str(tmp_path / "b.fft"))
    presto.write_spec(f, head, str(tmp_path / "b.spec"))
    for df, _ in (presto.read_fft(spark, str(tmp_path / "b.fft")), presto.read_spec(spark, str(tmp_path / "b.spec"))):
        assert [(r.re, r.im) for r in df.orderBy("k").collect()] == [(float(x[2 * i]), float(x[2 * i + 1])) for i in range(500)]


def test_inf_text():
    text = " Data file name without suffix          =  X\n Barycentered?           (1 yes, 0 no)  =  1\n Number of bins in the time series      =  131072     \n Width of each time series bin (sec)    =  0.00016384\n Central freq of low channel (MHz)      =  720.78125\n Total bandwidth (MHz)                  =  200\n Number of channels                     =  256\n Channel bandwidth (MHz)                =  0.78125\n J2000 Declination     (dd:mm:ss.ssss)  =  -08:47:43.7463\n"
    h = presto.inf_header(text)
    assert (h.nchans, h.nsamples, h.frame) == (256, 131072, "barycentric")
    assert h.fch1 == 720.78125 + 255 * 0.78125 and h.fmin == 720.78125 and h.dec == pytest.approx(-8.79548508)
    again = presto.inf_header(presto.make_inf(h, "X"))
    assert again.fch1 == h.fch1 and again.foff == h.foff and again.dec == pytest.approx(h.dec)


def card(key, value):
    v = f"'{value}'" if isinstance(value, str) else ("T" if value is True else "F" if value is False else repr(value))
    return f"{key:<8}= {v:>20}".ljust(80).encode()


def unit(cards):
    raw = b"".join(card(k, v) for k, v in cards) + b"END".ljust(80)
    return raw.ljust(-(-len(raw) // 2880) * 2880)


def psrfits_file(path, nsub=3, nsblk=8, npol=4, nchan=16, nbits=4, rising=False):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**nbits, (nsub, nsblk, npol, nchan)).astype(np.uint8)
    freqs = 1400.0 + (1 if rising else -1) * np.arange(nchan)
    scl, off, wts = rng.uniform(0.5, 2, (npol, nchan)), rng.uniform(-1, 1, (npol, nchan)), rng.integers(0, 2, nchan)
    nbyte = nsblk * npol * nchan * nbits // 8
    names = [("TSUBINT", "1D", 8), ("DAT_FREQ", f"{nchan}E", 4 * nchan), ("DAT_WTS", f"{nchan}E", 4 * nchan), ("DAT_OFFS", f"{npol * nchan}E", 4 * npol * nchan), ("DAT_SCL", f"{npol * nchan}E", 4 * npol * nchan), ("DATA", f"{nbyte}B", nbyte)]
    width = sum(n for *_, n in names)
    rows = b""
    for i in range(nsub):
        rows += struct.pack(">d", 1.0) + freqs.astype(">f4").tobytes() + wts.astype(">f4").tobytes() + off.astype(">f4").tobytes() + scl.astype(">f4").tobytes() + (bits.pack(x[i].ravel(), nbits) if nbits < 8 else x[i].ravel()).tobytes()
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", nsub), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(names)), ("EXTNAME", "SUBINT"), ("POL_TYPE", "AABBCRCI"), ("NPOL", npol), ("NBITS", nbits), ("NSBLK", nsblk), ("NCHAN", nchan), ("TBIN", 0.001), ("CHAN_BW", 1.0 if rising else -1.0), ("ZERO_OFF", 0.5)]
    for i, (n, f, _) in enumerate(names, 1):
        cards += [(f"TTYPE{i}", n), (f"TFORM{i}", f)]
    first = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("FITSTYPE", "PSRFITS"), ("OBS_MODE", "SEARCH"), ("TELESCOP", "Parkes"), ("SRC_NAME", "X"), ("OBSFREQ", float(freqs.mean())), ("OBSBW", float(-nchan)), ("STT_IMJD", 55000), ("STT_SMJD", 43200), ("STT_OFFS", 0.0), ("RA", "05:34:31.9"), ("DEC", "+22:00:52.0")]
    other = unit([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 10), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 0), ("EXTNAME", "HISTORY")]) + b"\0" * 2880
    path.write_bytes(unit(first) + other + unit(cards) + rows.ljust(-(-len(rows) // 2880) * 2880, b"\0"))
    f4 = lambda a: a.astype(np.float32).astype(float)
    return ((x - 0.5) * f4(scl) + f4(off)) * wts


@pytest.mark.parametrize("nbits", [1, 2, 4, 8])
@pytest.mark.parametrize("rising", [False, True])
def test_psrfits(spark, tmp_path, nbits, rising):
    want = psrfits_file(tmp_path / "a.sf", nbits=nbits, rising=rising)
    if rising:
        want = want[..., ::-1]
    df, head = psrfits.read_psrfits(spark, str(tmp_path / "a.sf"), rows=2)
    got = np.array([r.spec for r in df.orderBy("t").collect()])
    assert np.allclose(got, ((want[:, :, 0] + want[:, :, 1]) / np.sqrt(2)).reshape(-1, 16))
    assert head.tstart == 55000.5 and head.nsamples == 24 and head.foff == -1 and head.extra["state"] == "AABBCRCI"
    every = psrfits.read_psrfits(spark, str(tmp_path / "a.sf"), poln="all", start=1, count=1)[0].orderBy("t").collect()
    assert [r.t for r in every] == list(range(8, 16)) and np.allclose([r.spec for r in every], want[1].reshape(8, -1))


def test_psrfits_columns_and_faults(spark, tmp_path):
    psrfits_file(tmp_path / "a.sf")
    assert psrfits.subint_columns(spark, str(tmp_path / "a.sf")).count() == 3 * 4 * 16
    (tmp_path / "b.sf").write_bytes(unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("FITSTYPE", "OTHER")]))
    with pytest.raises(ValueError, match="not a PSRFITS"):
        psrfits.layout(str(tmp_path / "b.sf"))


def test_mask_files(spark, tmp_path):
    m = spark.createDataFrame([(0, True), (1, False)], "c int, masked boolean")
    masks.save(m, HEAD, str(tmp_path / "m"), threshold=3.0)
    back, head, more = masks.load(spark, str(tmp_path / "m"))
    assert back.count() == 2 and head == HEAD and more == {"threshold": 3.0}
    with pytest.raises(ValueError):
        masks.file_type("x.txt")


def test_cli(spark, tmp_path, capsys):
    x = np.random.default_rng(3).integers(0, 256, (100, 16))
    path = write_raw(tmp_path / "a.fil", HEAD, x)
    cli.main(["header", "get", path, "nchans"])
    assert capsys.readouterr().out.strip() == "16"
    cli.main(["header", "update", path, "tsamp", "0.002"])
    assert sigproc.parse_header(path)["tsamp"] == 0.002
    cli.main(["extract", "samples", path, "-s", "10", "-n", "20"])
    got, head = sigproc.read_fil(spark, str(tmp_path / "a_samps_10_30.fil"))
    assert head.nsamples == 20 and (np.array([r.spec for r in got.orderBy("t").collect()]) == x[10:30]).all()
    cli.main(["extract", "bands", path, "--nchans", "8", "--per", "4", "-s", "4"])
    band, head = sigproc.read_fil(spark, str(tmp_path / "a_sub01.fil"))
    assert head.fch1 == 1492.0 and (np.array([r.spec for r in band.orderBy("t").collect()]) == x[:, 8:12]).all()
    cli.main(["clean", path, "-r", "1495:1496", "-s"])
    cleaned, _ = sigproc.read_fil(spark, str(tmp_path / "a_masked.fil"))
    assert len({r.spec[4] for r in cleaned.collect()}) == 1
    cli.main(["convert", path, str(tmp_path / "b.fil"), "-b", "2", "-t", "2", "-f", "2"])
    assert sigproc.read_header(str(tmp_path / "b.fil")).nchans == 8


def test_extract_channel_range_is_checked(spark):
    with pytest.raises(ValueError):
        filterbank.read_chan(spark.createDataFrame([("a", 0, [1.0])], "obs_id string, t long, spec array<double>"), HEAD, 16)


def test_block_of_a_file_reads_its_range(spark, tmp_path):
    for nbits in (8, 2):
        head = ObsHeader(nchans=3, fch1=1500.0, foff=-1.0, tsamp=0.001, nsamples=1000, nbits=nbits)
        rows = [("a", t, [float((t + c) % 2**nbits) for c in range(3)]) for t in range(1000)]
        path = str(tmp_path / f"{nbits}.fil")
        sigproc.write_fil(spark.createDataFrame(rows, "obs_id string, t long, spec array<double>"), head, path)
        got, small = sigproc.read_fil_block(spark, path, 253, 170, 1499.0, 2, chunk=100)
        assert got.rdd.getNumPartitions() == 2
        whole, header = sigproc.read_fil(spark, path)
        want, large = filterbank.read_block(whole, header, 253, 170, 1499.0, 2)
        plain = lambda df: sorted((r.t, list(r.spec)) for r in df.collect())
        assert plain(got) == plain(want) and len(plain(got)) == 170 and small == large


def test_writer_places_samples(spark, tmp_path):
    """Files of any packing are the same however the rows are dealt; gaps and repeats are refused and leave nothing behind."""
    rng = np.random.default_rng(8)
    for nbits, nchans, n in ((1, 3, 1001), (2, 5, 77), (4, 3, 500), (8, 7, 333), (32, 2, 100)):
        head = ObsHeader(nchans=nchans, fch1=1500.0, foff=-1.0, tsamp=0.001, nsamples=n, nbits=nbits)
        x = rng.integers(0, 2 ** min(nbits, 8), (n, nchans)).astype(float)
        df = spark.createDataFrame([("a", 40 + t, x[t].tolist()) for t in range(n)], "obs_id string, t long, spec array<double>")
        path = str(tmp_path / f"{nbits}.fil")
        sigproc.write_fil(df.repartition(5), head, path)
        size = sigproc.parse_header(path)["hdrlen"] + (n * nchans * nbits + 7) // 8
        assert (tmp_path / f"{nbits}.fil").stat().st_size == size
        got = np.array([r.spec for r in sigproc.read_fil(spark, path, chunk=64)[0].orderBy("t").limit(n).collect()])
        assert np.array_equal(got, x[: len(got)]) and len(got) >= n - 8
    for bad in (df.where("t <> 50"), df.unionAll(df.where("t = 50"))):
        with pytest.raises(Exception, match="missing or repeated"):
            sigproc.write_fil(bad, head, str(tmp_path / "bad.fil"))
    assert not list(tmp_path.glob("bad*"))
