"""The reversible integer 9/7 wavelet, in one and two dimensions and three levels.

A line is a window over a partition: the high-pass value of an odd sample and
the low-pass value of an even one need at most four neighbours, which lag and
lead give, with mirrored borders. So a pass is one shuffle by line whatever the
image's size, without halos or tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions.bits import shr
from bitweave.functions.tables import LEVEL, WEIGHTS

LEVELS = 3


def _neighbours(v: str, w):
    """The even samples before, after, and one further before and after an odd one, mirrored at the ends."""
    l1, l3, f1, f3 = F.lag(v, 1).over(w), F.lag(v, 3).over(w), F.lead(v, 1).over(w), F.lead(v, 3).over(w)
    return l1, F.coalesce(f1, l1), F.coalesce(l3, f1, l1), F.when(f3.isNotNull(), f3).when(f1.isNotNull(), f1).otherwise(F.coalesce(l3, l1))


def _predicted(v: str, w):
    """What the even samples around predict for an odd one."""
    e0, e1, before, after = _neighbours(v, w)
    return shr(e0 + e1 + shr(e0 + e1 - before - after, 3) + 1, 1)


def _around(h: str, w):
    """The sum of the high-pass values beside an even sample; the first has its right one twice."""
    return F.coalesce(F.lag(h).over(w), F.lead(h).over(w)) + F.lead(h).over(w)


def forward_1d(samples: DataFrame, line: Sequence[str], pos: str, v: str = "v", high: str = "high", at: str = "at") -> DataFrame:
    """Transform lines of even length: pos becomes high (0 low-pass, 1 high-pass) and at."""
    w = Window.partitionBy(*line).orderBy(pos)
    odd = F.col(pos) % 2 == 1
    lifted = samples.withColumn("__h", F.when(odd, F.col(v) - _predicted(v, w)))
    value = F.when(odd, F.col("__h")).otherwise(F.col(v) - shr(2 - _around("__h", w), 2))
    kept = [c for c in samples.columns if c not in (pos, v)]
    return lifted.select(*kept, (F.col(pos) % 2).cast("int").alias(high), shr(F.col(pos), 1).alias(at), value.alias(v))


def inverse_1d(coeffs: DataFrame, line: Sequence[str], high: str, at: str, pos: str = "pos", v: str = "v") -> DataFrame:
    """Undo forward_1d."""
    w = Window.partitionBy(*line).orderBy("__p")
    placed = coeffs.withColumn("__p", F.col(at) * 2 + F.col(high))
    evens = placed.withColumn("__e", F.when(F.col(high) == 0, F.col(v) + shr(2 - _around(v, w), 2)))
    value = F.when(F.col(high) == 0, F.col("__e")).otherwise(F.col(v) + _predicted("__e", w))
    kept = [c for c in coeffs.columns if c not in (high, at, v)]
    return evens.select(*kept, F.col("__p").alias(pos), value.alias(v))


def forward_level(pixels: DataFrame) -> DataFrame:
    """One level: image_id, z, y, x, v to image_id, z, kx, ky, r, c, v; kx and ky tell high-pass."""
    rows = forward_1d(pixels.select("image_id", "z", "y", "x", "v"), ("image_id", "z", "y"), "x", high="kx", at="c")
    return forward_1d(rows, ("image_id", "z", "kx", "c"), "y", high="ky", at="r").select("image_id", "z", "kx", "ky", "r", "c", "v")


def inverse_level(coeffs: DataFrame) -> DataFrame:
    columns = inverse_1d(coeffs, ("image_id", "z", "kx", "c"), "ky", "r", pos="y")
    return inverse_1d(columns, ("image_id", "z", "y"), "kx", "c", pos="x").select("image_id", "z", "y", "x", "v")


def forward(pixels: DataFrame) -> DataFrame:
    """Three levels: image_id, z, sb (0 to 9), r, c, v; sides have to be multiples of eight."""
    out, low = None, pixels
    for level in range(1, LEVELS + 1):
        one = forward_level(low)
        detail = one.where("kx + ky > 0").select("image_id", "z", (F.col("kx") + F.col("ky") * 2 + (LEVELS - level) * 3).cast("int").alias("sb"), "r", "c", "v")
        out = detail if out is None else out.unionByName(detail)
        low = one.where("kx + ky = 0").select("image_id", "z", F.col("r").alias("y"), F.col("c").alias("x"), "v")
    return out.unionByName(low.select("image_id", "z", F.lit(0).alias("sb"), F.col("y").alias("r"), F.col("x").alias("c"), "v"))


def inverse(coeffs: DataFrame) -> DataFrame:
    """Undo forward."""
    low = coeffs.where("sb = 0").select("image_id", "z", F.lit(0).alias("kx"), F.lit(0).alias("ky"), "r", "c", "v")
    for level in range(LEVELS, 0, -1):
        base = (LEVELS - level) * 3
        k = F.col("sb") - base
        detail = coeffs.where(F.col("sb").between(base + 1, base + 3)).select("image_id", "z", (k % 2).cast("int").alias("kx"), F.floor(k / 2).cast("int").alias("ky"), "r", "c", "v")
        low = inverse_level(low.unionByName(detail))
        if level > 1:
            low = low.select("image_id", "z", F.lit(0).alias("kx"), F.lit(0).alias("ky"), F.col("y").alias("r"), F.col("x").alias("c"), "v")
    return low


def _weight(weights: Sequence[int]):
    return F.element_at(F.array(*(F.lit(int(w)) for w in weights)), F.col("sb") + 1)


def scaled(coeffs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Multiply subbands by their weights, powers of two."""
    from bitweave.functions.bits import pow2

    return coeffs.withColumn("v", F.col("v") * pow2(_weight(weights)))


def unscaled(coeffs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    return coeffs.withColumn("v", shr(F.col("v"), _weight(weights)))


def subband_size(width: int, height: int, sb: int) -> tuple[int, int]:
    """(columns, rows) of a subband of a padded image."""
    up = lambda n: -(-n // 8) * 8 >> LEVEL[sb]
    return up(width), up(height)
