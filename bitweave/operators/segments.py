"""Blocks of 64 coefficients, segments of blocks, and what a segment's header needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.functions.tables import BLOCK, GAGGLE, place

KEY = ("image_id", "z", "segment_id")


def _block_place():
    """(block row, block column, index in the block) of a coefficient, from its subband and place."""
    sb, r, c = F.col("sb"), F.col("r"), F.col("c")
    scale = F.when(sb < 4, 1).when(sb < 7, 2).otherwise(4)
    a, b = r % scale, c % scale
    child = 4 + (sb - 4) * 4 + a * 2 + b
    grand = 16 + (sb - 7) * 16 + B.shr(a, 1) * 8 + B.shr(b, 1) * 4 + a % 2 * 2 + b % 2
    index = F.when(sb < 4, sb).when(sb < 7, child).otherwise(grand)
    return F.floor(r / scale).cast("bigint"), F.floor(c / scale).cast("bigint"), index.cast("int")


def blocks(coeffs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Gather a block's coefficients from ten subbands with one shuffle; sizes has padded_width by image_id.

    Returns image_id, z, blk (row-major), and content of 64 values: DC, three
    parents, twelve children, forty-eight grandchildren.
    """
    br, bc, index = _block_place()
    placed = coeffs.select("image_id", "z", br.alias("br"), bc.alias("bc"), index.alias("i"), "v")
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    gathered = placed.groupBy("image_id", "z", "br", "bc").agg(values.alias("content"))
    width = sizes.select("image_id", F.expr("padded_width div 8").alias("w"))
    return gathered.join(width, "image_id").select("image_id", "z", (F.col("br") * F.col("w") + F.col("bc")).alias("blk"), "content")


def unblocked(blocks_: DataFrame, widths: DataFrame) -> DataFrame:
    """The inverse: blocks and widths (image_id, w in blocks) to coefficients."""
    spark = blocks_.sparkSession
    where = spark.createDataFrame([(i, *place(i)[:4]) for i in range(BLOCK)], "i int, sb int, scale int, a int, b int")
    cells = blocks_.join(widths, "image_id").select("image_id", "z", F.expr("blk div w").alias("br"), F.expr("blk % w").alias("bc"), F.posexplode("content").alias("i", "v"))
    return cells.join(F.broadcast(where), "i").select("image_id", "z", "sb", (F.col("br") * F.col("scale") + F.col("a")).alias("r"), (F.col("bc") * F.col("scale") + F.col("b")).alias("c"), "v")


def cut(blocks_: DataFrame, size: int) -> DataFrame:
    """Number segments of `size` blocks, blocks within them and gaggles of sixteen blocks."""
    return blocks_.select("image_id", "z", F.expr(f"blk div {size}").alias("segment_id"), (F.col("blk") % size).alias("b"), F.expr(f"blk % {size} div {GAGGLE}").alias("gaggle"), "content")


def quantisation(bdepth_dc: Column, bdepth_ac: Column, weight: int) -> Column:
    """How many low bits of DC are coded by planes, from both depths."""
    half = F.floor(bdepth_ac / 2).cast("int") + 1
    left = bdepth_dc - half
    q = F.when(bdepth_dc <= 3, 0).when(left <= 1, bdepth_dc - 3).when(left > 10, bdepth_dc - 10).otherwise(half)
    return F.greatest(q, F.lit(weight)).cast("int")


def block_depths(segmented: DataFrame) -> DataFrame:
    """The AC depth of each block, with its DC value."""
    ac = F.aggregate(F.slice("content", 2, BLOCK - 1), B.big(0), lambda a, v: a.bitwiseOR(F.abs(v)))
    return segmented.select(*KEY, "b", "gaggle", F.element_at("content", 1).alias("dc"), B.bit_width(ac).alias("depth"))


def statistics(segmented: DataFrame, weight: int = 3) -> DataFrame:
    """Size, depths of DC and AC, and quantisation of each segment."""
    seen = block_depths(segmented).groupBy(*KEY).agg(F.count("*").alias("size"), F.bit_or(B.sign_folded(F.col("dc"))).alias("folded"), F.max("depth").alias("bdepth_ac"))
    depths = seen.select(*KEY, "size", B.signed_depth(F.col("folded")).alias("bdepth_dc"), "bdepth_ac")
    return depths.withColumn("q", quantisation(F.col("bdepth_dc"), F.col("bdepth_ac"), weight))


def differences(segmented: DataFrame, weight: int = 3, wide_dc: bool = False) -> DataFrame:
    """Quantised DC and AC depth of each block, and their folded differences to the block before.

    Returns the segment's key and statistics, b, gaggle, dc, low (the DC bits
    below the quantisation), depth, dc_n and ac_n (bits of the coded numbers),
    dc_q, dc_delta and ac_delta (null for a segment's first block, which is the
    reference). wide_dc takes the range one bit wider, as an older coder does.
    """
    stats = statistics(segmented, weight)
    w = Window.partitionBy(*KEY).orderBy("b")
    rows = block_depths(segmented).join(stats, list(KEY))
    rows = rows.withColumn("dc_n", F.greatest(F.col("bdepth_dc") - F.col("q"), F.lit(1))).withColumn("ac_n", B.bit_width(F.col("bdepth_ac").cast("bigint")))
    rows = rows.withColumn("dc_q", B.shr(F.col("dc"), F.col("q"))).withColumn("low", F.pmod(F.col("dc"), B.pow2(F.col("q"))))
    half = B.pow2(F.col("dc_n") - (0 if wide_dc else 1))
    dc = B.folded_difference(F.col("dc_q"), F.lag("dc_q").over(w), -half, half - 1)
    depth = F.col("depth").cast("bigint")
    ac = B.folded_difference(depth, F.lag(depth).over(w), B.big(0), B.pow2(F.col("ac_n")) - 1)
    # numbers of one bit are sent as they are
    return rows.withColumn("dc_delta", F.when(F.lag("dc_q").over(w).isNotNull(), F.when(F.col("dc_n") > 1, dc).otherwise(F.pmod("dc_q", B.big(2))))).withColumn("ac_delta", F.when(F.lag(depth).over(w).isNotNull(), F.when(F.col("ac_n") > 1, ac).otherwise(depth)))
