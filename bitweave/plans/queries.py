"""Queries of the raster engine over the embeddings table, read as an image of one channel.

Row y is vec_id, column x the component, and the value floor(4096 * component).
Segments have SIZE blocks, so the last one is shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.functions import tables as T
from bitweave.operators import entropy, protocol, rice, segments, settings, tiles, wavelet, words
from bitweave.plans import codec
from bitweave.sources import raster
from bitweave.sources.scratch import stored

SIZE = 100
SLICE = (100, 10, 50, 40)
#: Stretches of lines that a sparse settings table could name: (first segment, blocks, heuristic).
SETTINGS = ((0, 100, False), (2, 100, False), (3, 64, True), (5, 64, True))
#: Settings that change with segments, as the coder takes them.
CHANGES = ((1, {"segment_size": 64, "heuristic_dc": True}), (3, {"segment_size": 80, "heuristic_ac": True}), (4, {"heuristic_dc": False}))
#: The wide image: its width, and how many vectors stand beside each other in a line.
WIDE, ACROSS, CHANNELS = 509, 8, 3


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return raster.from_vectors(table, row="vec_id", values="embedding", image_id="embeddings")


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope with little on it: deep DC coefficients beside shallow AC ones."""
    return image(spark, sf_dir).withColumn("v", F.col("y") * 40 + F.col("x") * 3 + F.shiftright("v", 9))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of several tiles, with sides that aren't multiples of eight: lines of ACROSS vectors, cut off at WIDE, without the last line."""
    one = image(spark, sf_dir).select("image_id", F.expr(f"y div {ACROSS}").alias("y"), (F.col("y") % ACROSS * 64 + F.col("x")).alias("x"), "v").where(F.col("x") < WIDE)
    lines = one.join(one.agg((F.max("y")).alias("lines")), F.col("y") < F.col("lines")).drop("lines")
    channel = F.explode(F.array(*(F.struct(F.lit(z).alias("z"), v.cast("bigint").alias("v")) for z, v in enumerate((F.col("v"), -F.col("v"), F.col("v") * 3 + F.col("x"))))))
    return lines.select("image_id", "y", "x", channel.alias("c")).select("image_id", "c.z", "y", "x", "c.v")


def _padded(spark, sf_dir):
    return raster.padded(image(spark, sf_dir))


def _blocks(spark, sf_dir, weights=T.WEIGHTS):
    return codec.blocks_of(image(spark, sf_dir), weights)


def _cut(spark, sf_dir):
    return segments.cut(_blocks(spark, sf_dir), SIZE)


def _cut_once(spark, sf_dir):
    """For queries that read the segments more than once."""
    return codec.segmented(image(spark, sf_dir), SIZE)


def _coeffs(spark, sf_dir, weights):
    pixels = image(spark, sf_dir)
    widths = raster.meta(pixels).select("image_id", F.expr("padded_width div 8").alias("w"))
    return segments.unblocked(_blocks(spark, sf_dir, weights), widths).select("sb", "r", "c", "v")


def img_from_embeddings(spark, sf_dir):
    return image(spark, sf_dir).select("y", "x", "v")


def img_padded(spark, sf_dir):
    return _padded(spark, sf_dir).select("y", "x", "v")


def img_transpose(spark, sf_dir):
    return raster.transposed(image(spark, sf_dir)).select("y", "x", "v")


def img_slice(spark, sf_dir):
    return raster.sliced(image(spark, sf_dir), *SLICE).select("y", "x", "v")


def img_linear(spark, sf_dir):
    return raster.linear(image(spark, sf_dir), 1000, 5000).select("lin", "v")


def img_append(spark, sf_dir):
    pixels = image(spark, sf_dir)
    return raster.appended(raster.sliced(pixels, 0, 0, 100, 64), pixels).select("y", "x", "v")


def img_meta(spark, sf_dir):
    return raster.meta(image(spark, sf_dir)).select("width", "height", "channels", "bdepth", "padded_width", "padded_height", "pad_rows")


def img_generate(spark, sf_dir):
    return raster.generate(spark, 64, 48, channels=3, bdepth=12).select("z", "y", "x", "v")


def dwt1d_row(spark, sf_dir):
    return wavelet.forward_1d(_padded(spark, sf_dir).select("y", "x", "v"), ("y",), "x").select("y", "high", "at", "v")


def idwt1d_row(spark, sf_dir):
    rows = wavelet.forward_1d(_padded(spark, sf_dir).select("y", "x", "v"), ("y",), "x")
    return wavelet.inverse_1d(rows, ("y",), "high", "at", pos="x").select("y", "x", "v")


def dwt2d_l1(spark, sf_dir):
    return wavelet.forward_level(_padded(spark, sf_dir)).select("kx", "ky", "r", "c", "v")


def dwt2d_l3(spark, sf_dir):
    return _coeffs(spark, sf_dir, (0,) * 10)


def subband_scale(spark, sf_dir):
    return _coeffs(spark, sf_dir, T.WEIGHTS)


def subband_unscale(spark, sf_dir):
    return wavelet.unscaled(_coeffs(spark, sf_dir, T.WEIGHTS)).select("sb", "r", "c", "v")


def idwt_roundtrip(spark, sf_dir):
    meta = raster.meta(image(spark, sf_dir))
    return tiles.to_pixels(_blocks(spark, sf_dir), meta).select("y", "x", "v")


def blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("blk", F.array_join("content", ",").alias("content"))


def segment_cut(spark, sf_dir):
    return _cut(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("size"), F.max("gaggle").alias("last_gaggle"), F.max("b").alias("last_block"))


def bdepth(spark, sf_dir):
    return segments.statistics(_cut(spark, sf_dir)).select("segment_id", "size", "bdepth_dc", "bdepth_ac", "q")


def block_depth(spark, sf_dir):
    return segments.block_depths(_cut(spark, sf_dir)).select("segment_id", "b", "gaggle", "dc", "depth")


def _differences(spark, sf_dir):
    return segments.differences(_cut_once(spark, sf_dir))


def quant_dc(spark, sf_dir):
    return _differences(spark, sf_dir).select("segment_id", "b", "dc_q", "low")


def dc_delta(spark, sf_dir):
    return _differences(spark, sf_dir).select("segment_id", "b", "dc_delta")


def ac_delta(spark, sf_dir):
    return _differences(spark, sf_dir).select("segment_id", "b", "ac_delta")


def reference_sample(spark, sf_dir):
    return _differences(spark, sf_dir).where("b = 0").select("segment_id", F.col("dc_q").alias("reference_dc"), F.col("depth").alias("reference_ac"))


def _k(spark, sf_dir, heuristic):
    rows = _differences(spark, sf_dir)
    one = lambda kind: rice.chosen(rows, kind, heuristic).select("segment_id", F.lit(kind).alias("kind"), "gaggle", "n", F.col("j").alias("numbers"), "k")
    return one("dc").unionByName(one("ac"))


def k_optimal(spark, sf_dir):
    return _k(spark, sf_dir, False)


def k_heuristic(spark, sf_dir):
    return _k(spark, sf_dir, True)


def dc_bits(spark, sf_dir):
    return rice.coded(_differences(spark, sf_dir), "dc").select("segment_id", "gaggle", "bits")


def acdepth_bits(spark, sf_dir):
    return rice.coded(_differences(spark, sf_dir), "ac").select("segment_id", "gaggle", "bits")


def _words(spark, sf_dir):
    cut = _cut_once(spark, sf_dir)
    return words.words(cut, segments.statistics(cut))


def _shown(rows):
    bits = F.coalesce("raw", B.bits_of(F.col("val"), F.col("len")))
    return rows.select("segment_id", "b", "plane", "stage", "seq", bits.alias("bits"))


def types_words(spark, sf_dir):
    return _shown(_words(spark, sf_dir).where("kind like 'types%'"))


def signs_words(spark, sf_dir):
    return _shown(_words(spark, sf_dir).where("kind = 'signs'"))


def tran_words(spark, sf_dir):
    return _shown(_words(spark, sf_dir).where("kind like 'tran%'"))


def refinement_bits(spark, sf_dir):
    return _shown(_words(spark, sf_dir).where("kind = 'refinement'"))


def stage0_dc(spark, sf_dir):
    return _shown(_words(spark, sf_dir).where("kind = 'dc'"))


def additional_dc(spark, sf_dir):
    cut = segments.cut(codec.blocks_of(smooth(spark, sf_dir)), SIZE)
    return words.additional_dc(cut, segments.statistics(cut)).select("segment_id", "b", "plane", "bit")


def smooth_roundtrip(spark, sf_dir):
    """Files with additional DC planes, and back."""
    return codec.restore(codec.compress(smooth(spark, sf_dir), codec.Settings(segment_size=SIZE))).select("y", "x", "v")


def wide_meta(spark, sf_dir):
    return raster.meta(wide(spark, sf_dir)).select("width", "height", "channels", "bdepth", "padded_width", "padded_height", "pad_rows")


def wide_blocks(spark, sf_dir):
    """Blocks across the seams of tiles, and of padding on both sides."""
    return codec.blocks_of(wide(spark, sf_dir)).select("z", "blk", F.array_join("content", ",").alias("content"))


def wide_roundtrip(spark, sf_dir):
    files = codec.compress(wide(spark, sf_dir), codec.Settings(segment_size=SIZE))
    return codec.restore(files, strict=True).select("z", "y", "x", "v")


def channel_count(spark, sf_dir):
    """Channels by the flags of first and last segments."""
    heads = protocol.parsed(codec.compress(wide(spark, sf_dir), codec.Settings(segment_size=SIZE)))
    return protocol.channels(heads).select("channels", "consistent")


def _changing(spark, sf_dir):
    return codec.compress(image(spark, sf_dir), codec.Settings(segment_size=SIZE), CHANGES)


def settings_coded(spark, sf_dir):
    """Sizes, places and flags of segments whose settings change, by their headers."""
    rows = codec.scanned(_changing(spark, sf_dir))
    return rows.select("segment_id", F.col("size").cast("bigint").alias("size"), F.col("start").cast("bigint").alias("start"), "part2", "part3", "optimal_dc", "optimal_ac")


def settings_roundtrip(spark, sf_dir):
    return codec.restore(_changing(spark, sf_dir), strict=True).select("y", "x", "v")


def header_check(spark, sf_dir):
    """Problems of files of which one is lost, one cut off, one no segment file and one there twice."""
    files = stored(_files(spark, sf_dir), "files")  # read twice
    n = F.col("segment_id")
    content = F.when(n == 2, F.expr("substring(content, 1, 40)")).when(n == 3, F.expr("overlay(content placing x'00' from 10)")).otherwise(F.col("content"))
    broken = files.where("segment_id <> 1").withColumn("content", content)
    broken = broken.unionByName(files.where("segment_id = 4"))
    return protocol.problems(protocol.parsed(broken)).select("z", "segment_id", "problem")


def bare_size(spark, sf_dir):
    """Segments without an envelope: their bytes, and the bytes before the data."""
    files = codec.compress(image(spark, sf_dir), codec.Settings(segment_size=SIZE, protocol="memory"))
    return protocol.parsed(files, protocol="memory").select("segment_id", "n_bytes", F.col("header_end").cast("bigint").alias("header_end"), "bdepth_dc", "bdepth_ac")


def part_bits(spark, sf_dir):
    """Streams without the depths of blocks and without their grandchildren."""
    rules = entropy.Rules(parts=tuple(p for p in entropy.PARTS if p not in ("bdepth_ac", "stage_3")))
    return entropy.segment_bits(_cut(spark, sf_dir), rules=rules).select("segment_id", "n_bits", F.md5("bits").alias("digest"))


def symbols(spark, sf_dir):
    return entropy.symbol_counts(_cut(spark, sf_dir)).select("segment_id", "plane", "len", "sym", "n")


def vlc_option(spark, sf_dir):
    return entropy.gaggle_options(_cut(spark, sf_dir)).select("segment_id", "plane", "gaggle", "len", "option", "n", "bits")


def vlc_length(spark, sf_dir):
    return entropy.stage_lengths(_cut(spark, sf_dir)).select("segment_id", "plane", "stage", "bits")


def segment_bits(spark, sf_dir):
    return entropy.segment_bits(_cut(spark, sf_dir)).select("segment_id", "n_bits", F.md5("bits").alias("digest"))


def early_stop(spark, sf_dir):
    """Bits of streams that stop in plane 4 after the parents."""
    return entropy.segment_bits(_cut(spark, sf_dir), rules=entropy.Rules(stop_plane=4, stop_stage=1)).select("segment_id", "n_bits", F.md5("bits").alias("digest"))


def _files(spark, sf_dir):
    return codec.compress(image(spark, sf_dir), codec.Settings(segment_size=SIZE))


def segment_file(spark, sf_dir):
    return _files(spark, sf_dir).select("segment_id", "n_bytes", F.hex(F.substring("content", 1, protocol.HEADER)).alias("head"), F.sha2("content", 256).alias("digest"))


def compressed_size(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count("*").alias("segments"), F.sum("n_bytes").alias("n_bytes"))


def header_scan(spark, sf_dir):
    return codec.scanned(_files(spark, sf_dir)).select("segment_id", "marker", "offset", "first", "last", "bdepth_dc", "bdepth_ac", "size", "width", "pad_rows")


def decode_roundtrip(spark, sf_dir):
    return codec.restore(_files(spark, sf_dir)).select("y", "x", "v")


def _settings(spark):
    return spark.createDataFrame(list(SETTINGS), "from_segment bigint, blocks int, heuristic boolean")


def settings_asof(spark, sf_dir):
    stats = segments.statistics(_cut(spark, sf_dir)).select("segment_id", "size")
    return settings.as_of(stats, _settings(spark)).select("segment_id", "size", "from_segment", "blocks", "heuristic", "strict")


def settings_dedupe(spark, sf_dir):
    return settings.deduplicated(_settings(spark))


def seq_check(spark, sf_dir):
    stats = segments.statistics(_cut(spark, sf_dir)).where("segment_id <> 1").select("image_id", "z", "segment_id")
    return settings.gaps(stats).select("segment_id", "expected")


ALL = (
    img_from_embeddings, img_padded, img_transpose, img_slice, img_linear, img_append, img_meta, img_generate, dwt1d_row, idwt1d_row, dwt2d_l1, dwt2d_l3, subband_scale, subband_unscale, idwt_roundtrip,
    blocks, segment_cut, bdepth, block_depth, quant_dc, dc_delta, ac_delta, reference_sample, k_optimal, k_heuristic, dc_bits, acdepth_bits,
    types_words, signs_words, tran_words, refinement_bits, stage0_dc, additional_dc, symbols, vlc_option, vlc_length, segment_bits, early_stop,
    segment_file, compressed_size, header_scan, decode_roundtrip, settings_asof, settings_dedupe, seq_check,
    smooth_roundtrip, wide_meta, wide_blocks, wide_roundtrip, channel_count, settings_coded, settings_roundtrip, header_check, bare_size, part_bits,
)
QUERIES = {f.__name__: f for f in ALL}
