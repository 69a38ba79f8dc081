"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` names its steps in order. Each takes (spark, docs, sf_dir), works on all that
its predecessor kept, and returns a DataFrame that is written as Parquet and read again; all
but the last return the columns of documents. What a stage does with nulls, empty and
very long texts, ties, repeated rows, empty tables and further columns is what its operator
states in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesframe.llm import exact_dedup, mixing, packing, quality, simhash
from salesframe.llm.queries import learning_labels
from salesframe.session import drop_written, passing_scratch, write_table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays."""
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words each source gives to the mix, as documents: one row per pass over a document."""
    mixed = mixing.mix_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good_documents),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, fingerprints and tokenizer can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        # a stage's own tables go when its result is written, and that one when the next is
        with passing_scratch(spark) as kept:
            docs, path = write_table(stage(spark, docs, sf_dir), name)
            kept.add(path)
        if last:
            drop_written(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
