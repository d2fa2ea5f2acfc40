"""Names of sources and sinks, so that a command line or a configuration can choose one.

A source makes a DataFrame from options; a sink takes one. Either is registered
under a name and may be replaced. Tables that a session wants to keep by name
are temp views: put, get, names and drop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SOURCES: dict[str, Callable[..., DataFrame]] = {}
SINKS: dict[str, Callable[..., object]] = {}
_PREFIX = "bitweave_"


def source(name: str):
    """Register a function of (spark, **options) as a source."""

    def add(make):
        SOURCES[name] = make
        return make

    return add


def sink(name: str):
    """Register a function of (df, **options) as a sink."""

    def add(take):
        SINKS[name] = take
        return take

    return add


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, **options)


def write(df: DataFrame, name: str, **options):
    if name not in SINKS:
        raise KeyError(f"no sink {name}; there are {', '.join(sorted(SINKS))}")
    return SINKS[name](df, **options)


def put(df: DataFrame, name: str) -> DataFrame:
    """Keep a table under a name in its session."""
    df.createOrReplaceTempView(_PREFIX + name)
    return df


def get(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(_PREFIX + name)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name.removeprefix(_PREFIX) for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(_PREFIX))


def drop(spark: SparkSession, name: str) -> bool:
    """Forget a name; whether it was there."""
    return spark.catalog.dropTempView(_PREFIX + name)


@source("table")
def _table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


@source("noise")
def _noise(spark, width: int, height: int, **options) -> DataFrame:
    from bitweave.sources import raster

    return raster.generate(spark, width, height, **options)


@source("vectors")
def _vectors(spark, path: str, **options) -> DataFrame:
    from bitweave.sources import raster

    return raster.from_vectors(spark.read.parquet(path), **options)


@source("segments")
def _segments(spark, path: str, **options) -> DataFrame:
    from bitweave.sources import files

    return files.read_segments(spark, path, **options)


@sink("segments")
def _to_segments(df, path: str, **options) -> DataFrame:
    from bitweave.sources import files

    return files.write_segments(df, path, **options)


@sink("table")
def _to_table(df, path: str, **options) -> None:
    df.write.mode(options.pop("mode", "errorifexists")).options(**options).parquet(path)


@sink("memory")
def _to_memory(df, view: str) -> DataFrame:
    return put(df, view)
