"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm.common import stored, table
from bitweave.llm.decontaminate import decontaminate
from bitweave.llm.jaccard import BROADCAST_ROWS, jaccard_classes
from bitweave.llm.langid import UNKNOWN, identify
from bitweave.llm.packing import pack
from bitweave.llm.queries import language_model, tokenizer_path

#: A document goes if no language is this likely.
LEAST_LIKELY = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier knows; those without a letter go.

    The classifier learns from the labels among docs. Without any label nothing
    can be told, so nothing goes.
    """
    model = language_model(docs)
    if not model["labels"]:
        return docs
    found = identify(docs, model, lang_out="__lang", score_out="__score")
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_LIKELY)).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near-duplicates.

    Documents without words or with a null id are in no class and stay. Of rows
    that repeat an id and a text one stays.
    """
    classes = jaccard_classes(docs.select("doc_id", "text")).where("doc_id is not null")
    ids = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("__stays"), F.count("*").alias("__rows"))
    ids = stored(ids.withColumnRenamed("doc_id", "__id"), "ids")
    gone = ids.where("not __stays").select("__id")
    if gone.count() <= BROADCAST_ROWS:  # else the documents are dealt by id
        gone = F.broadcast(gone)
    out = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    if not ids.where("__stays and __rows > 1").isEmpty():
        named, bare = out.where("doc_id is not null"), out.where("doc_id is null")
        out = named.dropDuplicates(["doc_id", "text"]).unionByName(bare)
    return out


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole window of a benchmark item; an item shorter than a window is one window."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where("n_hit = 0").select("row.*")  # items without an id count as well


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, with a small encoder: executors hold what earlier stages have left as well."""
    return pack(docs, tokenizer_path(), chunk=1 << 18, keep_pieces=400_000)


STAGES = [("language", known_language), ("near-duplicates", one_of_each), ("decontamination", without_benchmarks), ("packing", packed)]
#: SQL can express neither the classifier nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
