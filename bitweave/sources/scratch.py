"""Tables that are written once and read by several branches of a plan."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths that the open scopes have written, the innermost last.
_scopes: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """The folder that all nodes share, spark.checkpoint.dir.

    Only where the setting is unset and the executors are threads of this
    machine, as in tests, a local folder is made; elsewhere that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="bitweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends there, so lost executors cost no recomputation beyond it.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/bitweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what was stored inside: results that read it have to be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _scopes.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
