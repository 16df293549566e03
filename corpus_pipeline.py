"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the stage before it kept, written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import langid, mixing, packing, secret_scan, simhash
from cloakframe.llm.common import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter and texts far from every language go."""
    model = langid.fit_languages(docs)
    return langid.identify_languages(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard index of five-word shingles 0.8 or more), the one with the smallest doc_id."""
    return simhash.deduplicated(docs.select(*COLUMNS), shingle=5, likeness=(4, 5))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redacted(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in its order; documents that it repeats are repeated."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in packed sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("simhash_dedup", deduplicate), ("secret_scan", mask_secrets), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Hashed fingerprints, trained centroids and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
