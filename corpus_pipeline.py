"""A training corpus from raw documents.

Five stages, each over all that the one before kept: learned quality rules, exact dedup, n-gram
Jaccard join, pseudonyms for personal data, packing. All but the last return the columns of
``documents``. Each takes null ids and texts, repeated rows and empty tables as its operator
describes them; a document without an id is kept or dropped like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import exactdup, ngramjoin, packing, pii, quality
from veritab.llm.common import cut, table
from veritab.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base checks or the list learned from ``labels`` reject go."""
    return quality.apply(docs, table(spark, sf_dir, "labels")).filter("__kept").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return exactdup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id stays.

    Links: 0.8 or more of all five-word shingles are shared.
    A document is named by its id and the hash of its text, as ids may repeat or be missing.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    groups = ngramjoin.join(docs.select(name.alias("name"), "text"), id_col="name", percent=80, words=5)
    gone = groups.filter("id <> component_id").select(F.col("id.doc_id").alias("gone_id"), F.col("id.hash").alias("gone_hash"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by pseudonyms; ``n_chars`` follows where a text changed."""
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids, one row for each piece."""
    return packing.pack(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram join", near_stage),
    ("private data", private_stage),
    ("packing", packing_stage),
]
#: Learned rules and permutations are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it keeps is written once to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
