"""Images as tables of pixels: image_id, z, y, x, v.

An image is any table with these columns; z is the channel, y and x count from
0 and v is an integer. Absent pixels are not allowed inside an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = ("image_id", "z", "y", "x", "v")
#: Sides are padded to multiples of this.
STEP = 8
#: The noise's modulus, and its factors with the shifts that fold before each.
NOISE = 1 << 31, ((1274126177, 13), (1103515245, 16))


def from_vectors(vectors: DataFrame, *, row: str, values: str, image_id: str = "image", scale: int = 4096) -> DataFrame:
    """A matrix as an image: a row for each vector, its components scaled and rounded down."""
    cells = vectors.select(F.col(row).cast("bigint").alias("y"), F.posexplode(values).alias("x", "e"))
    return cells.select(F.lit(image_id).alias("image_id"), F.lit(0).alias("z"), "y", F.col("x").cast("bigint").alias("x"), F.floor(F.col("e").cast("double") * scale).cast("bigint").alias("v"))


def generate(spark: SparkSession, width: int, height: int, *, channels: int = 1, bdepth: int = 12, signed: bool = True, seed: int = 1067, image_id: str = "noise") -> DataFrame:
    """Waves and noise in a range of bdepth bits, the same for the same seed.

    The noise comes from the place by multiplying and folding modulo 2**31, so
    any partitioning gives the same pixels, and so does SQL elsewhere. Unsigned
    images hold magnitudes.
    """
    wide = spark.range(height * width * channels)
    y, x, z = F.expr(f"id div {width} % {height}"), F.col("id") % width, F.expr(f"id div {width * height}")
    cells = wide.select(z.cast("int").alias("z"), y.alias("y"), x.alias("x"))
    h = (F.col("z") * F.lit(83492791).cast("bigint") + F.col("y") * F.lit(73856093).cast("bigint") + F.col("x") * F.lit(19349663).cast("bigint") + F.lit(seed * 12345).cast("bigint")) % NOISE[0]
    for factor, shift in NOISE[1]:
        h = h.bitwiseXOR(F.shiftright(h, shift)) * F.lit(factor).cast("bigint") % NOISE[0]
    noise = (h.bitwiseXOR(F.shiftright(h, 15)) % (1 << 20)) / (1 << 20)
    a = F.col("y") * 0.173 + F.col("x") * 0.0030679615757712823  # pi / 1024
    v = F.floor((noise * 8 - 4 + 2 * F.cos(a * 3) + 2 * F.sin(a * 2)) * 2.0 ** (bdepth - 4)).cast("bigint")
    return cells.select(F.lit(image_id).alias("image_id"), "z", "y", "x", (v if signed else F.abs(v)).alias("v"))


def meta(pixels: DataFrame) -> DataFrame:
    """Width, height, number of channels, depth and padding of each image."""
    from bitweave.functions.bits import sign_folded, signed_depth

    seen = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.max("z") + 1).cast("int").alias("channels"), F.bit_or(sign_folded(F.col("v"))).alias("folded"))
    up = lambda n: (F.ceil(F.col(n) / STEP) * STEP).cast("bigint")
    return seen.select("image_id", "width", "height", "channels", signed_depth(F.col("folded")).alias("bdepth"), up("width").alias("padded_width"), up("height").alias("padded_height"), (up("height") - F.col("height")).cast("int").alias("pad_rows"))


def padded(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Repeat the last column and the last row up to the next multiple of eight.

    A pixel of the last column or row stands for itself and its copies, so the
    padding needs no join of a grid, only the image's size: sizes, as of meta,
    or else it is counted.
    """
    if sizes is None:
        size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    else:
        size = sizes.select("image_id", (F.col("width") - 1).alias("mx"), (F.col("height") - 1).alias("my"))
    joined = pixels.join(size, "image_id")
    until = lambda at, last: F.when(F.col(at) == F.col(last), (F.floor(F.col(last) / STEP) + 1) * STEP - 1).otherwise(F.col(at)).cast("bigint")
    xs = joined.withColumn("x", F.explode(F.sequence("x", until("x", "mx"))))
    return xs.withColumn("y", F.explode(F.sequence("y", until("y", "my")))).select(*PIXELS)


def transposed(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "z", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def sliced(pixels: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A rectangle, with its own coordinates from 0."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return pixels.where(inside).select("image_id", "z", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def appended(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The rows of one image below those of another with the same id and width."""
    size = top.groupBy("image_id").agg((F.max("y") + 1).alias("h"))
    moved = bottom.join(size, "image_id").select("image_id", "z", (F.col("y") + F.col("h")).alias("y"), "x", "v")
    return top.select(*PIXELS).unionByName(moved)


def linear(pixels: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """Pixels with their row-major place, optionally a stretch of places."""
    width = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    out = pixels.join(width, "image_id").withColumn("lin", F.col("y") * F.col("w") + F.col("x"))
    out = out.where(F.col("lin") >= start)
    return (out if length is None else out.where(F.col("lin") < start + length)).select("image_id", "z", "lin", "v")


def trimmed(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Cut the padding off."""
    return pixels.where((F.col("x") < width) & (F.col("y") < height))
