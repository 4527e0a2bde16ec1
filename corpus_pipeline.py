"""A corpus pipeline over `documents`: good ones, one of each near-duplicate group, without benchmark passages, mixed, sharded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import delete, read, shared_folder, temporary_tables
from auditlake.llm.decontaminate import clean_documents
from auditlake.llm.jaccard_join import first_of_each
from auditlake.llm.mixing import mixture
from auditlake.llm.quality import good_documents
from auditlake.llm.sharding import shards_by_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have a score like any other, null ids are no label's; repeated rows stay or go together; a table
    of any length of text, or of no rows, and columns of any other name pass through.
    """
    return good_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of the n-gram Jaccard join.

    Ties (a repeated id) are settled by the text's hash; null ids come last, so they stay where a component has no other.
    Texts without words are components of their own: they stay, repeated ones once for each id.
    """
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Null and empty texts stay; rows that share an id are judged each by its own text."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are never taken; a null source is a source of its own."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix; repeated rows, null ids and null texts have slots like any other."""
    return shards_by_bytes(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The classifier and the seeded choice have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written to the shared folder and read again.

    A stage's own tables go once its result is written, and its input then too, so the folder holds two results at most.
    """
    docs, last = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
