"""Command line: compress images held as pixel tables, restore segment files."""

from __future__ import annotations

import argparse
import sys

from bitweave.functions.tables import WEIGHTS


def _range(low: int, high: int):
    def number(text: str) -> int:
        value = int(text, 0)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{value} is not in {low} to {high}")
        return value

    return number


def _change(text: str) -> tuple[int, dict]:
    """SEGMENT:KEY=VALUE[,KEY=VALUE...]; a key alone is a flag."""
    from bitweave.plans.codec import BY_SEGMENT

    try:
        segment, _, rest = text.partition(":")
        pairs = [p.partition("=") for p in rest.split(",")]
        out = int(segment, 0), {k: (v.lower() in ("1", "true", "yes") if k in FLAGS else int(v, 0)) if eq else True for k, eq, v in pairs}
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text} is not SEGMENT:KEY=VALUE,...") from e
    if unknown := [k for k in out[1] if k not in BY_SEGMENT]:
        raise argparse.ArgumentTypeError(f"no setting {unknown[0]}; there are {', '.join(BY_SEGMENT)}")
    return out


#: Settings that are on or off.
FLAGS = ("heuristic_dc", "heuristic_ac", "use_fill", "dc_only")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bitweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compress", help="pixels to segment files")
    c.add_argument("--pixels", help="Parquet table of image_id, z, y, x, v")
    c.add_argument("--generate", nargs=2, type=_range(17, 1 << 20), metavar=("WIDTH", "HEIGHT"), help="a generated image instead")
    c.add_argument("--channels", type=_range(1, 1 << 16), default=1)
    c.add_argument("--bdepth", type=_range(4, 28), default=12)
    c.add_argument("--seed", type=int, default=1067)
    c.add_argument("--unsigned", action="store_true")
    c.add_argument("--dst", required=True, help="folder of the files")
    c.add_argument("--dwt", choices=("integer", "fp"), default="integer")
    c.add_argument("--shifts", nargs=10, type=_range(0, 3), default=WEIGHTS, metavar="W")
    c.add_argument("--size", type=_range(16, 1 << 20), default=1024, help="blocks of a segment")
    c.add_argument("--heuristic-dc", action="store_true")
    c.add_argument("--heuristic-ac", action="store_true")
    c.add_argument("--transpose", action="store_true")
    c.add_argument("--codeword", type=int, choices=range(8, 65, 8), default=64)
    c.add_argument("--limit", type=_range(32, 1 << 27), default=1 << 27, help="bytes of a segment")
    c.add_argument("--fill", action="store_true")
    c.add_argument("--stop-bitplane", type=_range(0, 31), default=0)
    c.add_argument("--stop-stage", type=_range(0, 4), default=4)
    c.add_argument("--stop-dc", action="store_true")
    c.add_argument("--at", action="append", type=_change, default=[], metavar="SEGMENT:KEY=VALUE,...", help="settings that hold from a segment on")
    c.add_argument("--protocol", choices=("file", "memory"), default="file", help="files with an envelope, or bare headers and data")
    c.add_argument("--id", default=None, help="image id, in place of the table's")
    r = commands.add_parser("restore", help="segment files to pixels")
    r.add_argument("--path", required=True, help="folder or glob of segment files")
    r.add_argument("--protocol", choices=("file", "memory"), default="file")
    r.add_argument("--strict", action="store_true", help="stop at any problem of headers or sequence")
    r.add_argument("--transpose", choices=("yes", "no"), default=None, help="in place of what the headers say")
    r.add_argument("--limit", type=_range(8, 1 << 27), default=None, help="bytes of a segment to read")
    r.add_argument("--stop-bitplane", type=_range(0, 31), default=0)
    r.add_argument("--stop-stage", type=_range(0, 4), default=4)
    r.add_argument("--stop-dc", action="store_true")
    r.add_argument("--report", action="store_true", help="print the problems of headers and sequence")
    r.add_argument("--dst", required=True, help="Parquet table to write")
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from bitweave.operators import protocol
    from bitweave.plans import codec
    from bitweave.sources import registry

    if a.command == "compress":
        options = codec.Settings(segment_size=a.size, weights=tuple(a.shifts), heuristic_dc=a.heuristic_dc, heuristic_ac=a.heuristic_ac, signed=not a.unsigned, transpose=a.transpose, codeword=a.codeword, byte_limit=a.limit, use_fill=a.fill, dc_only=a.stop_dc, stop_plane=a.stop_bitplane, stop_stage=a.stop_stage, dwt=a.dwt, protocol=a.protocol)
        errors, warnings = options.problems()
        if bool(a.pixels) == bool(a.generate):
            errors.append("exactly one of --pixels and --generate is needed")
        try:
            codec.Timeline(options, a.at) if not errors else None
        except codec.InvalidSettings as e:
            errors.append(str(e))
        for text in warnings:
            print(f"warning: {text}", file=sys.stderr)
        for text in errors:
            print(f"error: {text}", file=sys.stderr)
        if errors:
            return 2
        spark = SparkSession.builder.getOrCreate()
        if a.pixels:
            pixels = registry.read(spark, "table", path=a.pixels)
        else:
            pixels = registry.read(spark, "noise", width=a.generate[0], height=a.generate[1], channels=a.channels, bdepth=a.bdepth, signed=not a.unsigned, seed=a.seed)
        if a.id is not None:
            pixels = pixels.withColumn("image_id", F.lit(a.id))
        total = registry.write(codec.compress(pixels, options, a.at), "segments", path=a.dst).selectExpr("count(*) as n", "sum(n_bytes) as b").collect()[0]
        print(f"{total.n} segments, {total.b} bytes")
        return 0
    spark = SparkSession.builder.getOrCreate()
    files = registry.read(spark, "segments", path=a.path)
    if a.report:
        for p in protocol.problems(protocol.parsed(files, protocol=a.protocol)).orderBy("image_id", "z", "segment_id", "problem").toLocalIterator():
            print(f"{p.image_id} channel {p.z} segment {p.segment_id}: {p.problem}", file=sys.stderr)
    try:
        pixels = codec.restore(files, strict=a.strict, protocol_=a.protocol, transpose=None if a.transpose is None else a.transpose == "yes", byte_limit=a.limit, stop_plane=a.stop_bitplane, stop_stage=a.stop_stage, dc_only=a.stop_dc)
    except protocol.HeaderError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    registry.write(pixels, "table", path=a.dst)
    return 0


if __name__ == "__main__":
    sys.exit(main())
