"""Command line: splatlake INPUT.ply OUTPUT [--max-depth N ...]; exit code 0, or 2 for a conversion error."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from dataclasses import fields

from .plans.options import ConversionError, TilingOptions


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="splatlake")
    out.add_argument("input", nargs="?")
    out.add_argument("output", nargs="?")
    for f in fields(TilingOptions):
        flags = ["--" + f.name.replace("_", "-")] + (["--obb"] if f.name == "oriented_bounding_boxes" else [])
        if isinstance(f.default, bool):
            out.add_argument(*flags, dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            kind = int if f.type in ("int", "int | None") else float if f.type in ("float", "float | None") else str
            out.add_argument(*flags, dest=f.name, type=(lambda v, k=kind: None if v == "auto" else k(v)), default=f.default)
    return out


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.convert import convert

    args = vars(parser().parse_args(argv))
    source, output = args.pop("input"), args.pop("output")
    spark = SparkSession.builder.appName("splatlake").getOrCreate()
    try:
        if args["self_test"]:
            from .sources.ply import write_splats
            from .sources.synthetic import cloud

            output = output or source or os.path.join(tempfile.gettempdir(), "splatlake-self-test")
            os.makedirs(output, exist_ok=True)
            source = os.path.join(output, "self_test.ply")
            write_splats(cloud(spark, args["self_test_count"]), source)
        if not source or not output:
            raise ConversionError("an input and an output are needed")
        if not os.path.exists(source):
            raise ConversionError(f"no such file: {source}")
        convert(spark, source, output, **args)
    except (ConversionError, ValueError) as e:  # a bad file, no splats, a refused tile
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
