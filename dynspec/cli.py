"""``python -m dynspec.cli header|extract|clean|convert``: headers, parts and cleaning of filterbank files."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _header(args: argparse.Namespace) -> None:
    from .sources import masks, psrfits, sigproc

    kind = args.format or masks.file_type(args.file)
    if kind in ("fbh5", "shdf5"):
        raise SystemExit("HDF5 headers need a library that is not at hand")
    if kind == "pfits":
        lay = psrfits.layout(args.file)
        values = psrfits.to_header(lay).to_dict()
    else:
        values = sigproc.parse_header(args.file)
    if args.action == "print":
        print(json.dumps(values, indent=1, default=str))
    elif args.action == "get":
        print(values[args.key])
    else:
        old = values[args.key]
        sigproc.edit_header(args.file, args.key, type(old)(args.value))


def _extract(args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from .operators import filterbank
    from .sources import presto, sigproc

    spark = _spark()
    spectra, header = sigproc.read_fil(spark, args.file)
    base = args.out or os.path.splitext(args.file)[0]
    if args.part == "samples":
        cut, head = filterbank.extract_samples(spectra, header, args.start, args.nsamps)
        sigproc.write_fil(cut, head, f"{base}_samps_{args.start}_{args.start + args.nsamps}.fil")
    elif args.part == "channels":
        chans = args.chans or list(range(header.nchans))
        rows = filterbank.extract_chans(spectra, header, chans)
        for c in chans:
            head = header.updated(nchans=1, fch1=header.fch1 + c * header.foff)
            presto.write_tim(rows.where(F.col("c") == c), head, f"{base}_chan{c:04d}.tim")
    else:
        rows = filterbank.extract_bands(spectra, header, args.start, args.nchans, args.per)
        per = args.per or args.nchans
        for b in range(args.nchans // per):
            head = header.updated(nchans=per, fch1=header.fch1 + (args.start + b * per) * header.foff, nbits=32)
            sigproc.write_fil(rows.where(F.col("band") == b), head, f"{base}_sub{b:02d}.fil")


def _clean(args: argparse.Namespace) -> None:
    from .plans.search import clean_file
    from .sources import masks, sigproc

    spark = _spark()
    spectra, header = sigproc.read_fil(spark, args.file)
    ranges = [tuple(float(x) for x in r.split(":")) for r in args.ranges or []]
    base = args.out or os.path.splitext(args.file)[0]
    cleaned, mask = clean_file(spectra, header, args.method, args.threshold, ranges)
    sigproc.write_fil(cleaned, header, f"{base}_masked.fil")
    if args.save:
        masks.save(mask, header, f"{base}_mask", method=args.method, threshold=args.threshold)


def _convert(args: argparse.Namespace) -> None:
    from .model import explode_spectra, pack_spectra
    from .operators import filterbank
    from .sources import masks, psrfits, sigproc

    spark = _spark()
    spectra, header = (psrfits.read_psrfits if masks.file_type(args.file) == "pfits" else sigproc.read_fil)(spark, args.file)
    cells, head = filterbank.downsample(explode_spectra(spectra), header, args.tfactor, args.ffactor)
    if args.nbits < 32:
        cells = filterbank.requantize(cells, args.nbits)
    sigproc.write_fil(pack_spectra(cells), head.updated(nbits=args.nbits), args.out)


def main(argv: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="dynspec", description=__doc__)
    sub = top.add_subparsers(required=True)

    p = sub.add_parser("header")
    p.add_argument("action", choices=["print", "get", "update"])
    p.add_argument("file")
    p.add_argument("key", nargs="?")
    p.add_argument("value", nargs="?")
    p.add_argument("-f", "--format", choices=["sigproc", "pfits", "fbh5", "shdf5"])
    p.set_defaults(run=_header)

    p = sub.add_parser("extract")
    p.add_argument("part", choices=["samples", "channels", "bands"])
    p.add_argument("file")
    p.add_argument("-s", "--start", type=int, default=0)
    p.add_argument("-n", "--nsamps", type=int, default=0)
    p.add_argument("-c", "--chans", type=int, nargs="*")
    p.add_argument("--nchans", type=int, default=0)
    p.add_argument("--per", type=int)
    p.add_argument("-o", "--out")
    p.set_defaults(run=_extract)

    p = sub.add_parser("clean")
    p.add_argument("file")
    p.add_argument("-m", "--method", choices=["mad", "iqrm"], default="mad")
    p.add_argument("-t", "--threshold", type=float, default=3.0)
    p.add_argument("-r", "--ranges", nargs="*", help="low:high in MHz")
    p.add_argument("-o", "--out")
    p.add_argument("-s", "--save", action="store_true", help="keep the mask")
    p.set_defaults(run=_clean)

    p = sub.add_parser("convert")
    p.add_argument("file")
    p.add_argument("out")
    p.add_argument("-b", "--nbits", type=int, default=8)
    p.add_argument("-t", "--tfactor", type=int, default=1)
    p.add_argument("-f", "--ffactor", type=int, default=1)
    p.set_defaults(run=_convert)

    args = top.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
