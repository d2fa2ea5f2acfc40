"""Segment headers and the file envelope, as expressions over a segment's row.

Parts 1A, 1B, 2, 3 and 4 are strings of bits until a file's bytes are made. A
file begins with 32 bytes: an envelope (8 bytes of size, the offset of the
headers, the marker 5E, version, parameters, a reserved byte) and the headers,
which end at byte 32. In memory segments may also go bare: headers and data
without an envelope.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.functions import tables as T
from bitweave.sources.scratch import stored

HEADER, MARKER, VERSION = 32, 0x5E, 0x10


class HeaderError(ValueError):
    """Segments whose headers can't be used; the message lists the first of them."""

#: (name, bits) of each part; `spare` fields are zero.
PARTS = {
    "1A": (("first", 1), ("last", 1), ("count", 8), ("bdepth_dc", 5), ("bdepth_ac", 5), ("spare", 1), ("part2", 1), ("part3", 1), ("part4", 1)),
    "1B": (("pad_rows", 3), ("spare", 5)),
    "2": (("byte_limit", 27), ("dc_stop", 1), ("plane_stop", 5), ("stage_stop", 2), ("use_fill", 1), ("spare", 4)),
    "3": (("size", 20), ("optimal_dc", 1), ("optimal_ac", 1), ("spare", 2)),
    "4": (("dwt_type", 1), ("spare", 1), ("deep_pixels", 1), ("signed", 1), ("pixel_depth", 4), ("width", 20), ("transpose", 1), ("codeword", 3), ("custom", 1), *((f"weight{9 - k}", 2) for k in range(10)), ("spare", 11)),
}


def part_bits(part: str, fields: dict[str, Column]) -> Column:
    """A part's bits; a field that isn't given is zero. Values keep their low bits, as counters wrap."""
    return F.concat(*(F.lit("0" * n) if name not in fields else B.bits_of(fields[name].cast("bigint"), n) for name, n in PARTS[part]))


def part_length(part: str) -> int:
    return sum(n for _, n in PARTS[part])


def codeword_code(bits: int) -> int:
    """The three bits that stand for a codeword of 8 to 64 bits: the quarter of 64 above, then its half."""
    if bits % 8 or not 8 <= bits <= 64:
        raise ValueError(f"a codeword can't have {bits} bits")
    k = bits // 8 - 1
    return (k % 4) * 2 + k // 4


def codeword_bits(code: int) -> int:
    return (code // 2 + 1) * 8 + code % 2 * 32


def header_bits(*, codeword: int = 64, weights=T.WEIGHTS) -> Column:
    """Headers of a segment's row.

    The row has first, last, segment_id, bdepth_dc, bdepth_ac, pad_rows, width,
    pixel_depth, signed, transpose, size, with_settings (parts 2 and 3 are
    sent), with_size (part 3 is sent), byte_limit, dc_stop, plane_stop,
    stage_stop, use_fill, heuristic_dc and heuristic_ac. A segment of 2**20
    blocks has a size field of 0.
    """
    c = F.col
    part3 = c("with_settings") | c("with_size")
    one = {"first": c("first"), "last": c("last"), "count": c("segment_id"), "bdepth_dc": c("bdepth_dc"), "bdepth_ac": c("bdepth_ac"), "part2": c("with_settings"), "part3": part3, "part4": c("first_of_image")}
    two = {k: c(k) for k in ("byte_limit", "dc_stop", "plane_stop", "stage_stop", "use_fill")}
    three = {"size": c("size"), "optimal_dc": ~c("heuristic_dc"), "optimal_ac": ~c("heuristic_ac")}
    four = {"signed": c("signed"), "deep_pixels": c("pixel_depth") > 16, "pixel_depth": c("pixel_depth"), "width": c("width"), "transpose": c("transpose"), "codeword": F.lit(codeword_code(codeword)), "custom": F.lit(tuple(weights) != T.WEIGHTS)}
    four |= {f"weight{k}": F.lit(int(w)) for k, w in enumerate(weights)}
    flag = lambda fields: {k: v.cast("int") if k not in ("count", "bdepth_dc", "bdepth_ac") else v for k, v in fields.items()}
    return F.concat(
        part_bits("1A", flag(one)),
        F.when(c("last"), part_bits("1B", {"pad_rows": c("pad_rows")})).otherwise(""),
        F.when(c("with_settings"), part_bits("2", flag(two))).otherwise(""),
        F.when(part3, part_bits("3", flag(three))).otherwise(""),
        F.when(c("first_of_image"), part_bits("4", flag(four))).otherwise(""),
    )


def enveloped(headers: bytes, data: bytes) -> bytes:
    """A file's bytes: envelope, headers and data."""
    envelope = (len(headers) + len(data)).to_bytes(8, "big") + bytes([HEADER - len(headers), MARKER, VERSION, 0, 0])
    # only the fields that the headers leave room for: they cover the envelope's tail from their offset on
    room = HEADER - len(headers)
    return envelope[:room].ljust(room, b"\0") + headers + data


def assembled(rows: DataFrame, codeword: int, protocol: str = "file") -> DataFrame:
    """Segments with their headers, as files or bare: image_id, z, segment_id, size, content.

    rows: the key, size, headers (a string of bits), bits (binary), most (bytes
    of headers and data) and use_fill. Data are filled with zeros up to whole
    codewords, cut off after `most` bytes, and with use_fill filled up to them.
    """

    def run(batches):
        for batch in batches:
            out = []
            for headers, data, most, fill in zip(*(batch.column(c).to_pylist() for c in range(4, 8)), strict=True):
                head = int("1" + headers, 2).to_bytes(len(headers) // 8 + 1, "big")[1:]
                word = codeword // 8
                data = data.ljust(-(-len(data) // word) * word, b"\0")[: most - len(head)]
                data = data.ljust(most - len(head), b"\0") if fill else data
                out.append(enveloped(head, data) if protocol == "file" else head + data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["image_id", "z", "segment_id", "size", "content"])

    return rows.select("image_id", "z", "segment_id", "size", "headers", "bits", "most", "use_fill").mapInArrow(run, "image_id string, z int, segment_id bigint, size bigint, content binary")


def _field(bits: Column, at: Column, width: int) -> Column:
    return F.conv(F.substring(bits, at, F.lit(width)), 2, 10).cast("bigint")


def parsed(files: DataFrame, content: str = "content", protocol: str = "file") -> DataFrame:
    """Header fields of each file, from its first 32 bytes; parts that aren't there are null.

    marker, version, declared_bytes and offset come from the envelope; for
    protocol "memory" there is none and they are null. header_end is the number of bytes
    before the data.
    """
    hexes = F.hex(F.substring(content, 1, HEADER))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HEADER // 4 - 1)), lambda i: F.lpad(F.conv(F.rpad(F.substring(hexes, i * 8 + 1, F.lit(8)), 8, "0"), 16, 2), 32, "0")), "")
    rows = files.withColumn("__h", bits)
    if protocol == "file":
        rows = rows.withColumn("marker", _field(F.col("__h"), F.lit(73), 8)).withColumn("version", _field(F.col("__h"), F.lit(81), 8)).withColumn("declared_bytes", _field(F.col("__h"), F.lit(1), 64)).withColumn("offset", _field(F.col("__h"), F.lit(65), 8))
        rows = rows.withColumn("__at", F.when(F.col("offset") < HEADER, F.col("offset")).otherwise(0).cast("int") * 8 + 1)
    else:
        rows = rows.withColumns({k: F.lit(None).cast("bigint") for k in ("marker", "version", "declared_bytes", "offset")}).withColumn("__at", F.lit(1))
    present = {"1A": F.lit(True), "1B": F.col("last") == 1, "2": F.col("part2") == 1, "3": F.col("part3") == 1, "4": F.col("part4") == 1}
    for part, fields in PARTS.items():
        at, named = 0, {}
        for name, n in fields:
            if name != "spare":
                named[name] = F.when(present[part], _field(F.col("__h"), F.col("__at") + at, n))
            at += n
        rows = rows.withColumns(named).withColumn("__at", F.when(present[part], F.col("__at") + at).otherwise(F.col("__at")))
    return rows.withColumn("header_end", F.floor((F.col("__at") - 1) / 8).cast("int")).drop("__h", "__at")


def problems(parsed_: DataFrame, content: str = "content") -> DataFrame:
    """What is wrong with each segment and each image's sequence of them: image_id, z, segment_id, problem.

    A file may be no segment file (marker, version), cut off (truncated), or
    have headers that end elsewhere than its envelope says (headers). A
    channel may lack a segment (gap), its first or last one, have two of a number (repeated), and an image
    as many first flags as last flags must have (channels, without z and segment_id).
    """
    from bitweave.operators import settings

    key = ("image_id", "z", "segment_id")
    # a handful of numbers for each segment, read by every check below, so that files aren't made or read for each
    parsed_ = stored(parsed_.select(*key, "first", "last", "marker", "version", "declared_bytes", "offset", "header_end", F.length(content).alias("__bytes")), "headers")
    size = F.col("__bytes")
    enveloped_ = F.col("marker").isNotNull()
    checks = {
        "marker": enveloped_ & (F.col("marker") != MARKER) | (size < 4),
        "version": (F.col("marker") == MARKER) & (F.col("offset") > 10) & (F.col("version") != VERSION),
        "truncated": enveloped_ & (F.col("declared_bytes") + F.col("offset") > size),
        "headers": enveloped_ & (F.col("header_end") != HEADER),
    }
    each = parsed_.select(*key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("problem"))
    seen = parsed_.groupBy("image_id", "z").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.min("segment_id").alias("a"), F.max("segment_id").alias("b"))
    ends = seen.select("image_id", "z", F.explode(F.array_compact(F.array(F.when(F.col("first") == 0, F.struct(F.col("a").alias("segment_id"), F.lit("first").alias("problem"))), F.when(F.col("last") == 0, F.struct(F.col("b").alias("segment_id"), F.lit("last").alias("problem")))))).alias("p")).select("image_id", "z", "p.*")
    lost = settings.gaps(parsed_.select(*key).distinct()).select(*key, F.lit("gap").alias("problem"))
    twice = parsed_.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("problem"))
    unequal = channels(parsed_).where("not consistent").select("image_id", F.lit(None).cast("int").alias("z"), F.lit(None).cast("bigint").alias("segment_id"), F.lit("channels").alias("problem"))
    return each.unionByName(ends).unionByName(lost).unionByName(twice).unionByName(unequal)


def channels(parsed_: DataFrame) -> DataFrame:
    """Channels of each image by the flags of first and last segments, and whether both agree with each other."""
    flags = parsed_.groupBy("image_id").agg(F.sum("first").alias("firsts"), F.sum("last").alias("lasts"))
    return flags.select("image_id", F.col("firsts").alias("channels"), (F.col("firsts") == F.col("lasts")).alias("consistent"))
