"""Sparse settings by segment: a row holds from its segment on until the next row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(settings: DataFrame, key: str = "from_segment") -> DataFrame:
    """Settings in order without those that repeat the one before them."""
    values = [c for c in settings.columns if c != key]
    w = Window.orderBy(key)  # settings are a handful of rows for a session
    row = F.struct(*values)
    return settings.dropDuplicates().withColumn("__before", F.lag(row).over(w)).where(F.col("__before").isNull() | ~row.eqNullSafe(F.col("__before"))).drop("__before")


def held_at(at: Column, spans: Sequence[tuple], schema: str) -> Column:
    """The last of a few spans (tuples in order of their first field) that begins at or before a place; null before all."""
    fields = [f.split(" ") for f in schema.split(", ")]
    row = lambda span: F.struct(*(F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(fields, span, strict=True)))
    out = F.when(at >= spans[-1][0], row(spans[-1]))
    for span in reversed(spans[:-1]):
        out = out.when(at >= span[0], row(span))
    return out


def as_of(segments: DataFrame, settings: DataFrame, segment: str = "segment_id", key: str = "from_segment", bucket: int = 1 << 16) -> DataFrame:
    """Each segment with the settings that hold for it, and whether they begin there (strict).

    Segments before the first settings get nulls. Both sides are dealt to
    buckets of consecutive segments and put in order together, with the last
    settings before each bucket carried into it; nothing is compared with more
    than its own bucket.
    """
    values = [c for c in settings.columns if c != key]
    last = settings.groupBy(F.expr(f"{key} div {bucket}").alias("__k")).agg(F.max_by(F.struct(key, *values), key).alias("__last"))
    used = segments.select(F.expr(f"{segment} div {bucket}").alias("__k")).distinct()
    # one row for each bucket of segments or settings
    order = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(used, "__k", "full").withColumn("__last", F.last("__last", ignorenulls=True).over(order)).where("__last is not null").select("__k", "__last.*")
    every = settings.withColumn("__k", F.expr(f"{key} div {bucket}")).unionByName(carried.select(*settings.columns, "__k")).withColumn("__set", F.struct(key, *values))
    both = segments.withColumn("__k", F.expr(f"{segment} div {bucket}")).withColumn("__at", F.col(segment)).unionByName(every.select("__k", F.col(key).alias("__at"), "__set"), allowMissingColumns=True)
    w = Window.partitionBy("__k").orderBy("__at", F.col("__set").isNull())
    filled = both.withColumn("__set", F.last("__set", ignorenulls=True).over(w)).where(F.col(segment).isNotNull())
    return filled.select(*segments.columns, "__set.*").withColumn("strict", F.coalesce(F.col(segment) == F.col(key), F.lit(False)))


def gaps(segments: DataFrame, by=("image_id", "z"), segment: str = "segment_id") -> DataFrame:
    """Segments that don't follow the one before them, or don't begin with 0."""
    w = Window.partitionBy(*by).orderBy(segment)
    return segments.withColumn("expected", F.coalesce(F.lag(segment).over(w) + 1, F.lit(0))).where(F.col(segment) != F.col("expected"))
