"""The corpus queries, one for each operator, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm.common import crc_mod, table
from bitweave.llm.topk import TOP_K_SQL
from bitweave.llm.warc import WARC_SQL


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.tokenfile import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(), null_keys=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", "item_ids")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.license_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def language_model(docs: DataFrame) -> dict:
    """Fitted on the documents whose crc32(doc_id) modulo 4 isn't 2."""
    from bitweave.llm.langid import fit

    return fit(docs.where(crc_mod("doc_id", 4) != 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.langid import identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.lm import score

    docs = table(spark, sf_dir, "documents")
    return score(docs, held_out=crc_mod("doc_id", 10) == 0, tune=crc_mod("doc_id", 10) == 1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.warc import read_archive, write_archive

    archive = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitweave.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_license_scan, op3_language_id, op4_lm_score, op5_warc, op6_jaccard_join, op7_top_k, op8_token_files, op9_html_text, op10_decontaminate)}
ORACLES: dict[str, str] = {"op5_warc": WARC_SQL, "op7_top_k": TOP_K_SQL}
