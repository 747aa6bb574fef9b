"""Corpus preparation: each stage takes the documents that the one before it kept, written and read again in between.

Null, empty, very long and repeated texts are handled as the operators' docstrings say. No stage drops a row for any reason but
its own decision; all stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import minhash, packing, pii, substring, toxicity
from panelforge.llm.common import sent_if_few, stage

#: Not all stages can be said in SQL; they are tested against plain versions.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; those without text stay."""
    return toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest ``doc_id`` stays; rows that share an id stay together."""
    gone = stage(minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(sent_if_few(gone), "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 and more words that an earlier document has are taken out; documents stay, if need be empty."""
    return substring.without_repeats(docs, 50)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; texts without any stay as they are."""
    return pii.replaced(docs, pii.key_of(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024: a row a piece, as ``packing.pack`` returns. An empty text is its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("minhash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("pii surrogates", with_surrogates),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
