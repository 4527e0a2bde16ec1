"""Helpers shared by the operators: reading, cutting lineage, and the character classes of the contracts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: What stands between words of lower-cased text: every ASCII character but digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The folder of `temporary_tables` at work, if any.
FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores where its files give fewer tasks than that (one small file is one task, however much is done with its rows)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once, written to a table in the shared folder and read back, with its lineage cut.

    The folder is the cluster's own (`spark.checkpoint.dir`); only where none is set, as in tests, a temporary one is
    taken. A table that is read back has the size of its files, where a checkpoint keeps an estimate that grows
    with every join and after many rounds takes the driver's memory.
    """
    spark = df.sparkSession
    path = f"{FOLDER.get() or shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder among the cluster's checkpoints."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # One machine, as in tests: any folder of it is shared.
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes inside are deleted at the end: what is made of them must have been written by then."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    before = FOLDER.set(folder)
    try:
        yield
    finally:
        FOLDER.reset(before)
        delete(spark, folder)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage, the later the more memory it has.

    For steps that write each result by `cut` and read it back: a DataFrame that is run twice would shuffle twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there, by the file system that Spark itself uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is (`lower` would also change other letters)."""
    return F.translate(col, UPPER, LOWER)


def words_of(col: Column) -> Column:
    """Words of the lower-cased text: runs of digits, letters a-z and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(col), GAPS, -1), "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
