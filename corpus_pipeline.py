"""The corpus pipeline: rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideclock.llm import decontaminate, line_dedup, minhash, packing, quality_rules, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes; the others go.

    Null and empty texts have no words and go; a null source is a host of its
    own; repeated rows are judged each for itself; an empty table stays empty.
    """
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats or nearly repeats; ``n_chars`` is counted anew.

    Null texts stay null; null keys come first; equal rows are one document and
    keep the same lines; an empty table stays empty.
    """
    return line_dedup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that with the smallest id.

    Null and empty texts and rows without an id stay; rows of one id stay or go
    together; an empty table stays empty.
    """
    return minhash.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, be it its question or its answer.

    Null and empty texts stay; repeated rows stay or go together; an empty table
    stays empty, and an empty benchmark takes nothing away.
    """
    items = decontaminate.split_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.clean(docs, items)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, with the crc32 of their ids.

    Null and empty texts are the end id alone; null ids and repeated rows are
    packed like others; an empty table gives no rows.
    """
    packed = packing.pack(docs)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Tokens and their packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
