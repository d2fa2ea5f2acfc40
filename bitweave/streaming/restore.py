"""Restoring segment files as they arrive.

An extension: segments are decoded by themselves, so new files of a folder can
be turned into blocks continuously. Pixels need a whole image, hence a batch
plan over the blocks that have arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.functions import tables as T
from bitweave.operators import decode, protocol
from bitweave.sources.files import NAME


def decoded_stream(spark: SparkSession, folder: str, *, size: int, weights=T.WEIGHTS, compat: bool = False) -> DataFrame:
    """A stream of blocks (image_id, z, segment_id, b, content) of the files that arrive in folder.

    size is the session's segment size; a file that states its own has that.
    A stream sees no earlier file, so settings can't be carried over from one.
    """
    arriving = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.ccsds").load(folder)
    part = lambda k: F.regexp_extract("path", NAME, k)
    named = arriving.select(part(1).alias("image_id"), part(2).cast("int").alias("z"), part(3).cast("bigint").alias("segment_id"), "content")
    rows = protocol.parsed(named).withColumn("size", F.coalesce(F.col("size"), F.lit(size))).withColumn("data", F.expr(f"substring(content, {protocol.HEADER + 1})"))
    return decode.decoded(rows, weights, wide_dc=compat)
