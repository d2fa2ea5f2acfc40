"""Compressing images to segments and restoring them, as plans over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.functions import tables as T
from bitweave.operators import decode, entropy, protocol, segments, settings, tiles
from bitweave.operators.protocol import HeaderError
from bitweave.sources import raster
from bitweave.sources.scratch import stored

LEAST_SIDE, MOST_WIDTH, LEAST_SEGMENT, MOST_SEGMENT = 17, 1 << 20, 16, 1 << 20


class InvalidSettings(ValueError):
    """Settings that break a rule; the message lists all of them."""


@dataclass(frozen=True)
class Settings:
    """What a session encodes with. byte_limit counts headers and data, not the envelope."""

    segment_size: int = 1024
    weights: Sequence[int] = T.WEIGHTS
    heuristic_dc: bool = False
    heuristic_ac: bool = False
    signed: bool = True
    transpose: bool = False
    codeword: int = 64
    byte_limit: int = 1 << 27
    use_fill: bool = False
    dc_only: bool = False
    stop_plane: int = 0
    stop_stage: int = 4
    compat: bool = False
    dwt: str = "integer"
    protocol: str = "file"
    parts: Sequence[str] = entropy.PARTS

    def problems(self) -> tuple[list[str], list[str]]:
        """(errors, warnings)."""
        errors, warnings = [], []
        rules = (
            (LEAST_SEGMENT <= self.segment_size <= MOST_SEGMENT, f"a segment has {LEAST_SEGMENT} to {MOST_SEGMENT} blocks"),
            (len(self.weights) == 10 and all(0 <= w <= 3 for w in self.weights), "there are ten weights from 0 to 3"),
            (self.codeword % 8 == 0 and 8 <= self.codeword <= 64, "a codeword has 8 to 64 bits, in whole bytes"),
            (protocol.HEADER <= self.byte_limit <= 1 << 27, f"the byte limit is {protocol.HEADER} to {1 << 27}"),
            (0 <= self.stop_plane < 32 and 0 <= self.stop_stage <= 4, "the stop plane is 0 to 31 and the stop stage 0 to 4"),
            (self.dwt == "integer", "only the integer wavelet is there"),
            (self.protocol in ("file", "memory"), "the protocol is file or memory"),
            (set(self.parts) <= set(entropy.PARTS), f"the parts of a stream are {', '.join(entropy.PARTS)}"),
        )
        errors += [text for holds, text in rules if not holds]
        if self.dc_only and (self.stop_plane or self.stop_stage != 4):
            warnings.append("with dc_only the stop plane and stage have no effect")
        if self.use_fill and self.byte_limit == 1 << 27:
            warnings.append("filling up to the largest byte limit makes very large files")
        return errors, warnings

    def checked(self) -> Settings:
        if errors := self.problems()[0]:
            raise InvalidSettings("; ".join(errors))
        return self

    def rules(self) -> entropy.Rules:
        return entropy.Rules(self.heuristic_dc, self.heuristic_ac, self.compat, self.stop_plane, self.stop_stage, self.dc_only, tuple(self.parts))


#: Settings that may change from a segment on, and segments at which they may.
BY_SEGMENT = ("segment_size", "heuristic_dc", "heuristic_ac", "byte_limit", "use_fill", "dc_only", "stop_plane", "stop_stage")
MOST_CHANGES = 1000


class Timeline:
    """Settings by segment: each change holds from its segment on, and leaves as they are the settings that it doesn't name."""

    def __init__(self, options: Settings, changes: Iterable[tuple[int, dict]] | DataFrame = ()) -> None:
        if isinstance(changes, DataFrame):
            rows = changes.orderBy("from_segment").limit(MOST_CHANGES + 1).collect()
            changes = [(r["from_segment"], {k: v for k, v in r.asDict().items() if k != "from_segment" and v is not None}) for r in rows]
        changes = sorted(changes, key=lambda c: c[0])
        wrong = sorted({k for _, c in changes for k in c} - set(BY_SEGMENT))
        if wrong or len(changes) > MOST_CHANGES or any(i < 0 for i, _ in changes):
            raise InvalidSettings(f"{', '.join(wrong)} can't change by segment" if wrong else f"settings change at 0 to {MOST_CHANGES} segments from 0 on")
        held, block = [(0, 0, options.checked())], 0
        for i, change in changes:
            last, begin, before = held[-1]
            block, own = begin + (i - last) * before.segment_size, replace(before, **change).checked()
            if own != before:  # settings that repeat those before them are no change
                held = [*(held if i > last else held[:-1]), (i, block, own)]
        self.spans = held

    def at(self, number: int) -> Settings:
        from bisect import bisect_right

        return self.spans[bisect_right([i for i, _, _ in self.spans], number) - 1][2]

    def segment_of(self, block: Column) -> Column:
        """(segment_id, b, whether) of a block's number, as a struct of segment_id and b."""
        span = settings.held_at(block, [(begin, i, s.segment_size) for i, begin, s in self.spans], "block bigint, first bigint, size bigint")
        inside = block - span["block"]
        return F.struct((span["first"] + F.floor(inside / span["size"])).cast("bigint").alias("segment_id"), (inside % span["size"]).alias("b"))

    def columns(self, segment: Column) -> dict[str, Column]:
        """Each setting of a segment, and whether settings begin there (strict)."""
        kinds = {"segment_size": "bigint", "byte_limit": "bigint", "stop_plane": "int", "stop_stage": "int"}
        schema = ", ".join(["from_segment bigint", *(f"{k} {kinds.get(k, 'boolean')}" for k in BY_SEGMENT)])
        span = settings.held_at(segment, [(i, *(asdict(s)[k] for k in BY_SEGMENT)) for i, _, s in self.spans], schema)
        return {k: span[k] for k in BY_SEGMENT} | {"strict": span["from_segment"] == segment}


def check_images(meta: DataFrame) -> DataFrame:
    """meta, with an error for sides that the format can't hold."""
    fine = (F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE) & (F.col("width") <= MOST_WIDTH)
    return meta.withColumn("width", F.when(fine, F.col("width")).otherwise(F.raise_error(F.concat(F.lit("image sides out of range: "), F.col("image_id"))).cast("bigint")))


def blocks_of(pixels: DataFrame, weights: Sequence[int] = T.WEIGHTS, meta: DataFrame | None = None) -> DataFrame:
    """Pixels to blocks of coefficients: padding, wavelet and gathering in one shuffle."""
    return tiles.to_blocks(pixels, raster.meta(pixels) if meta is None else meta, weights)


def segmented(pixels: DataFrame, size: int, weights: Sequence[int] = T.WEIGHTS, meta: DataFrame | None = None) -> DataFrame:
    """Pixels to segments of blocks, stored, for plans that read them more than once."""
    return segments.cut(stored(blocks_of(pixels, weights, meta), "blocks"), size)


def stages(pixels: DataFrame, options: Settings = Settings(), by_segment: Iterable[tuple[int, dict]] | DataFrame = ()) -> dict[str, DataFrame]:  # noqa: B008
    """The steps from pixels to files, each a DataFrame that hasn't run: pixels, meta, blocks, segments, bits, files.

    by_segment: settings that change with segments, as pairs of a segment's
    number and a dict of settings (of BY_SEGMENT), or a table of from_segment
    and such columns, with nulls for what stays.
    """
    times = Timeline(options, by_segment)
    s = options
    if s.transpose:
        pixels = raster.transposed(pixels)
    meta = stored(check_images(raster.meta(pixels)), "meta")  # one row for each image, read by several steps
    blocks = blocks_of(pixels, s.weights, meta)
    cut = blocks.withColumn("__at", times.segment_of(F.col("blk"))).select("image_id", "z", "__at.*", "content").withColumn("gaggle", F.expr(f"b div {T.GAGGLE}"))
    coded = entropy.segment_bits(cut, s.weights, lambda number: times.at(number).rules())
    rows = coded.join(meta, "image_id").withColumns(times.columns(F.col("segment_id")))
    total = F.expr("padded_width div 8 * (padded_height div 8)")
    rows = rows.withColumn("last", F.col("segment_id") == times.segment_of(total - 1)["segment_id"]).withColumn("first", F.col("segment_id") == 0)
    limit = F.col("byte_limit")
    rows = rows.withColumns({"dc_stop": F.col("dc_only"), "plane_stop": F.col("stop_plane"), "stage_stop": F.least("stop_stage", F.lit(3)), "signed": F.lit(s.signed), "transpose": F.lit(s.transpose), "pixel_depth": F.col("bdepth")})
    # every channel's first segment repeats the settings, so channels can be restored one by one
    rows = rows.withColumns({"first_of_image": F.col("first"), "with_settings": F.col("first") | F.col("strict"), "with_size": F.col("last") & (F.col("size") != F.col("segment_size"))})
    head = rows.withColumn("most", limit.cast("bigint")).withColumn("byte_limit", limit % (1 << 27))
    head = head.withColumn("headers", protocol.header_bits(codeword=s.codeword, weights=s.weights))
    out = protocol.assembled(head, s.codeword, s.protocol).withColumn("n_bytes", F.length("content").cast("bigint"))
    return {"pixels": pixels, "meta": meta, "blocks": blocks, "segments": cut, "bits": coded, "files": out}


def compress(pixels: DataFrame, options: Settings = Settings(), by_segment: Iterable[tuple[int, dict]] | DataFrame = ()) -> DataFrame:  # noqa: B008
    """Images to segment files: image_id, z, segment_id, size, content, n_bytes; see stages for by_segment."""
    return stages(pixels, options, by_segment)["files"]


def scanned(files: DataFrame, protocol_: str = "file") -> DataFrame:
    """Headers of segment files with the settings that hold for each segment, and the number of its first block (start).

    files: image_id, z, segment_id, content. Settings are carried forward from
    the segment that sent them, within a channel. A missing segment counts
    with the size that held before it.
    """
    rows = protocol.parsed(files, protocol=protocol_)
    w = Window.partitionBy("image_id", "z").orderBy("segment_id")
    # the last segment's own size holds for it alone
    carried = [c for p in ("2", "3", "4") for c, _ in protocol.PARTS[p] if c != "spare"]
    held = {c: F.last(c, ignorenulls=True).over(w) for c in dict.fromkeys(carried)}
    nominal = F.first("size", ignorenulls=True).over(w)
    out = rows.withColumn("nominal_size", nominal).withColumns(held).withColumn("width", F.first("width", ignorenulls=True).over(w))
    # a size field of 0 stands for 2**20 blocks
    out = out.withColumn("size", F.when(F.col("size") == 0, F.lit(MOST_SEGMENT)).otherwise(F.col("size")))
    step = F.coalesce(F.lag("size").over(w) * (F.col("segment_id") - F.lag("segment_id").over(w)), F.col("segment_id") * F.col("size"))
    return out.withColumn("__step", step).withColumn("start", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def restore(files: DataFrame, *, compat: bool = False, trim: bool = True, strict: bool = False, protocol_: str = "file", transpose: bool | None = None, byte_limit: int | None = None, stop_plane: int = 0, stop_stage: int = 4, dc_only: bool = False, parts: Sequence[str] = entropy.PARTS) -> DataFrame:
    """Segment files to pixels, channel by channel, in parallel over segments and then over tiles.

    Files that aren't segments (protocol.problems: marker, version) are left
    out, and so are segments with a stream that no encoder writes; blocks of
    segments that are missing are zeros next to others, and absent where a
    whole tile is missing. Where a segment is lost that sent settings, those
    behind it are read with the settings before, up to the next that sends some. strict makes any problem a
    HeaderError before anything is decoded. transpose overrides what the
    headers say. byte_limit, stop_plane, stop_stage and dc_only end the reading
    of each segment early; parts are those that its stream has.
    """
    files = stored(files.select("image_id", "z", "segment_id", "content", F.monotonically_increasing_id().alias("__row")), "files")  # else each step below would make them anew
    heads = protocol.parsed(files, protocol=protocol_)
    if strict and (found := protocol.problems(heads).limit(10).collect()):
        raise HeaderError("; ".join(f"{r.image_id} channel {r.z} segment {r.segment_id}: {r.problem}" for r in found))
    if protocol_ == "file":
        files = heads.where((F.col("marker") == protocol.MARKER) & (F.col("header_end") == protocol.HEADER)).select(*files.columns)
    rows = scanned(files, protocol_).drop("content")  # in order by headers alone
    weights = F.when(F.col("custom") == 1, F.array(*(F.col(f"weight{k}").cast("int") for k in range(10)))).otherwise(F.array(*(F.lit(w) for w in T.WEIGHTS)))
    data = F.expr("substring(content, header_end + 1)")
    if byte_limit is not None:
        data = F.substring(data, F.lit(1), F.greatest(byte_limit - F.col("header_end") + (F.col("offset") if protocol_ == "file" else F.lit(0)), F.lit(0)).cast("int"))
    rows = stored(rows.withColumn("weights", weights), "scanned")
    own = rows.select("__row", "size", "bdepth_dc", "bdepth_ac", "weights", "start", "header_end", "offset")
    whole = files.join(own, "__row").withColumn("data", data).drop("content")
    blocks = decode.decoded(whole, wide_dc=compat, stop_plane=stop_plane, stop_stage=stop_stage, dc_only=dc_only, parts=parts, skip_broken=not strict)
    # sizes follow from the width, the blocks and the padding that the last segment states
    image = rows.groupBy("image_id", "z").agg(F.max("width").alias("width"), F.max(F.col("start") + F.col("size")).alias("n"), F.max("pad_rows").alias("pad_rows"), F.max("transpose").alias("turned"), F.first("weights").alias("weights"))
    image = image.withColumn("padded_width", (F.ceil(F.col("width") / 8) * 8).cast("bigint")).withColumn("padded_height", F.expr("ceil(n / (padded_width div 8)) * 8"))
    sizes = image.groupBy("image_id").agg(F.max("padded_width").alias("padded_width"), F.max("padded_height").alias("padded_height"), F.max("width").alias("width"), F.max("pad_rows").alias("pad_rows"), F.max("turned").alias("turned"), F.first("weights").alias("weights"))
    sizes = stored(sizes, "sizes")  # one row for each image
    pixels = tiles.to_pixels(blocks.select("image_id", "z", "blk", "content"), sizes)
    turned = F.col("turned") == 1 if transpose is None else F.lit(transpose)
    if trim:
        limits = sizes.select("image_id", F.col("width").alias("__w"), (F.col("padded_height") - F.coalesce("pad_rows", F.lit(0))).alias("__h"), "turned")
        pixels = pixels.join(limits, "image_id").where("x < __w and y < __h").select("image_id", "z", F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), "v")
    return pixels


def sequence_gaps(files: DataFrame) -> DataFrame:
    return settings.gaps(files)
