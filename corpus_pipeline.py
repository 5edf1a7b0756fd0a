"""A corpus pipeline of five operators over the documents table. Each stage reads what the one before has written.

All stages but the last give rows with the columns that they got, extra ones too, whatever their names; empty tables stay empty; very long
texts are worked on whole. What each does with nulls, ties and repeated rows is said there. `labels` has doc_id, quality and toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import exact_dedup, packing, quality, simhash, substring_dedup
from riskweave.llm.common import cut, forget, inner_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labelled text rejects go. Null and empty texts have weight 0 and stay if that is
    enough; ties at the last place stay; repeated rows go or stay together; without good labels all stay."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) the row with the largest doc_id stays, one of them if rows repeat; a null id only if
    there is no other."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays, one of them if rows repeat; null and empty texts are one class;
    a null id stays only if there is no other."""
    return simhash.drop_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has, or an earlier place of the same one, are taken out of texts; n_chars follows where
    a text changes. All rows stay; null texts stay null, rows with a null doc_id stay as they are."""
    return substring_dedup.drop_repeats(docs, chars_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2,048. Null texts are empty and have the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages documents are written to the shared checkpoint folder and read again; what a stage has written
    for itself, and the documents that it has read there, are removed when its own documents are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with inner_tables() as keep:
            done = keep(cut(stage(spark, docs, sf_dir)))
        if n:
            forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizers and fitted models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
