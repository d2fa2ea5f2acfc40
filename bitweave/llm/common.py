"""Helpers shared by the corpus operators: shared folders, tables, file access."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The C library's call that returns free memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and
    the executors are threads of this machine, as in tests, a local folder is
    made and set; elsewhere an unset folder is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="bitweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one table or set of files."""
    return f"{shared_root(spark)}/bitweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for Python code on any node; works for file, HDFS and object stores."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write the byte chunks under a temporary name and move the file into place.

    A task that is run again, or twice at once, leaves one whole file.
    """
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(temporary, path)
    return size


class FileWriter:
    """As put_file, for callers that write piece by piece while they do something else; close() moves the file into place."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = open_fs(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.temporary)

    def write(self, chunk: bytes) -> None:
        self.out.write(chunk)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.temporary, self.path)


def read_file(uri: str) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        return f.read()


def crc_mod(col: str, n: int):
    """crc32 of a column's text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Send whole texts to Python in batches of so many rows and bytes at most; 10,000 texts take much memory.

    Spark reads these settings when a plan runs, so they are lowered for the
    session. They change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = _bytes(spark.conf.get(key, str(most)))
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


#: What a Python worker keeps from task to task, by name.
kept: dict[str, object] = {}


def lean(run, keep: str | None = None):
    """A function for mapInArrow that bounds what a worker holds, as workers live on from task to task.

    Before a task everything kept under other names goes, and after it unused
    memory is given back to the system.
    """

    def wrapped(batches):
        forget_all_but(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def forget_all_but(keep: str | None) -> None:
    if gone := [name for name in kept if name != keep]:
        for name in gone:
            del kept[name]
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _bytes(text: str) -> int:
    """A number of Spark's settings, with its unit."""
    m = re.fullmatch(r"(-?\d+)([kmgt]?)b?", text.strip().lower())
    return int(m[1]) << 10 * " kmgt".index(m[2] or " ") if m else 0


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's statistics say that df holds, in bytes, without reading it; 0 if they say nothing of use."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
