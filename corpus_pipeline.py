"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, and byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
``run`` writes as Parquet and reads again as the next one's docs.  All stages but the last return the columns of
``documents``.

Defined results: a null or empty text fails the quality rules, and in the later stages, given such, it is kept (it
has no near copies, no personal data, rate 1, no tokens); a row of null ``doc_id`` is its own document; rows that agree
in every column are one document to the near-duplicate stage, which keeps one of them, and different texts under one
id are kept or left out together; ties (equal texts) go to the least id; texts are read whole; other columns, whatever
their names, are left out by every stage; an empty table gives an empty one.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, neardup, pii, quality
from tessera.llm.common import _remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoff."""
    return quality.judged(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least id (5-word shingles, similarity 0.8)."""
    docs = docs.select(COLUMNS)
    kept = neardup.near_duplicates(docs, k=5, threshold=80).where("kept").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = known.distinct()  # repeated rows are one document
    return known.unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in the place of personal data; their length is counted anew."""
    return pii.replace_pii(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rate says."""
    rated = mixing.mix(docs.select(COLUMNS), table(spark, sf_dir, "labels"), mixing.PIPELINE_WEIGHTS)
    taken = mixing.copies(F.col("rate"), F.col("doc_id"))
    times = F.when(taken > 0, F.sequence(F.lit(1), taken)).otherwise(F.array().cast("array<int>"))
    return rated.withColumn("_copy", F.explode(times)).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's encoding and of its decoding."""
    return bpe.op6_byte_bpe(spark, sf_dir, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", near_duplicates),
    ("pii_surrogates", personal_data),
    ("mixing", mixed),
    ("byte_bpe", byte_bpe),
]

#: No statement: signatures, keyed surrogates and fitted rates aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        atexit.register(_remove, spark, path)
        docs = spark.read.parquet(path)
    return docs
