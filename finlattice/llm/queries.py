"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, table
from . import common


def ready(spark: SparkSession) -> None:
    ship_package(spark)
    common.prepare(spark)

def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    ready(spark)
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False))



def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    ready(spark)
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_ledger

    ready(spark)
    docs = table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id", F.lit("arrival")), F.lit(2))  # all documents, in two arrivals on a new ledger
    return secret_ledger.digest(secret_ledger.scan_arrivals([docs.where(half == k) for k in range(2)], secret_ledger.Ledger(spark)))

def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    ready(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    ready(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))



def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    ready(spark)
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    ready(spark)
    return decontam.digest(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))

def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    ready(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)



def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    ready(spark)
    return langid.digest(langid.identify(table(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    ready(spark)
    return html_extract.digest(html_extract.extract(table(spark, sf_dir, "pages")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    ready(spark)
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents"), with_proof=False))


def op12_merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merge_tokens

    ready(spark)
    return merge_tokens.digest(merge_tokens.tokenize(table(spark, sf_dir, "documents"), with_ids=False))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked_search

    ready(spark)
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_secret_ledger, op4_packing, op5_embedding_dedup, op6_line_dedup, op7_decontamination, op8_minhash, op9_language_id, op10_html_extraction, op11_merkle_manifest, op12_merge_tokens, op13_ranked_search)}
