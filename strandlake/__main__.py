"""Command line: ``python -m strandlake compress IN OUT [options]`` and ``decompress IN OUT``."""

from __future__ import annotations

import argparse
import dataclasses

from .plans.api import Options, compress, decompress
from .session import local_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compress")
    d = commands.add_parser("decompress")
    for p in (c, d):
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--cores", default="*")
    for f in dataclasses.fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            c.add_argument(flag, action="store_true")
        else:
            c.add_argument(flag, type=int if "int" in f.type else str, default=f.default)
    d.add_argument("--gzip", action="store_true")
    d.add_argument("--gzip-level", type=int)
    args = parser.parse_args(argv)
    spark = local_session(args.cores)
    if args.command == "compress":
        compress(spark, args.source, args.target, Options(**{f.name: getattr(args, f.name) for f in dataclasses.fields(Options)}))
    else:
        decompress(spark, args.source, args.target, args.gzip, args.gzip_level)


if __name__ == "__main__":
    main()
