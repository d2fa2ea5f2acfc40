"""Segment files: listing, reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: {session}_channel_{z}_segment_{id}_{sink}.ccsds
NAME = r"([^/]+)_channel_(\d+)_segment_(\d+)_(\d+)\.ccsds$"


def file_name(session: str = "image_id", z: str = "z", segment: str = "segment_id"):
    return F.concat(F.col(session), F.lit("_channel_"), F.col(z), F.lit("_segment_"), F.col(segment), F.lit("_0.ccsds"))


def read_segments(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Segment files of a path or glob pattern: path, image_id, z, segment_id, content.

    Names sort naturally because their numbers are columns. limit keeps the
    first files in that order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ccsds").load(path)
    part = lambda k: F.regexp_extract("path", NAME, k)
    rows = files.where(part(1) != "").select("path", part(1).alias("image_id"), part(2).cast("int").alias("z"), part(3).cast("bigint").alias("segment_id"), "content")
    return rows if limit is None else rows.orderBy("image_id", "z", "segment_id").limit(limit)


def write_segments(encoded: DataFrame, folder: str, byte_limit: int | None = None) -> DataFrame:
    """Write each segment to a file of its own; returns path and n_bytes.

    A file is written under another name and moved into place, so a task that
    runs again leaves one whole file. byte_limit cuts a file after so many bytes.
    """
    content = F.col("content") if byte_limit is None else F.substring("content", 1, byte_limit)

    def run(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                uri = f"{folder.rstrip('/')}/{name}"
                files, path = (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith(("/", "file:")) else fs.FileSystem.from_uri(uri)
                files.create_dir(os.path.dirname(path), recursive=True)
                with files.open_output_stream(temporary := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(raw)
                files.move(temporary, path)
                out.append((uri, len(raw)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out]), pa.array([n for _, n in out], pa.int64())], names=["path", "n_bytes"])

    return encoded.select(file_name().alias("name"), content.alias("content")).mapInArrow(run, "path string, n_bytes long")
