"""Tables that are published as whole versions.

A root folder holds `data`, a folder for each published table, and `pointers`, a row for each version that names the folders of all
tables. Data are written first; the pointer is one small file that appears at once when its write is committed. So a
reader sees all tables as they were before a change, or all as they are after it, and a writer that fails half way leaves nothing that
anybody reads. Tables that a version does not change keep their folder.

Writers of one root take turns: a version is the successor of the one its writer has read, and `expect` makes sure of that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "number long, batch long, tables map<string,string>, written timestamp"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """number, batch, tables (name and folder of each), written of every version."""
    try:
        return spark.read.schema(POINTERS).parquet(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTERS)


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number and tables of the newest version; 0 and none before the first."""
    last = versions(spark, root).orderBy(F.desc("number"), F.desc("written")).select("number", "tables").first()
    return (last["number"], dict(last["tables"])) if last else (0, {})


def read_version(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """A table as the newest version, or that of a number, has it."""
    if number is None:
        number, tables = current(spark, root)
    else:
        found = versions(spark, root).filter(F.col("number") == number).select("tables").first()
        tables = dict(found["tables"]) if found else {}
    if table not in tables:
        raise KeyError(f"version {number} of {root} has no table {table}")
    return spark.read.parquet(f"{root}/{tables[table]}")


def point(spark: SparkSession, root: str, number: int, batch: int | None, tables: dict[str, str]) -> None:
    rows = spark.createDataFrame([(number, batch, tables)], "number long, batch long, tables map<string,string>")
    rows.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def publish(spark: SparkSession, root: str, changed: dict[str, DataFrame], batch: int | None = None, expect: int | None = None) -> int:
    """Writes the changed tables and then points to them; the number of the version.

    A batch that has been published before, as after a restart of a stream, is not published again.
    """
    if batch is not None and not (done := versions(spark, root).filter(F.col("batch") == batch)).isEmpty():
        return done.agg(F.max("number")).first()[0]
    number, tables = current(spark, root)
    if expect is not None and number != expect:
        raise ValueError(f"{root} is at version {number}, not {expect}")
    for name, df in changed.items():
        folder = f"data/{name}-{number + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        tables[name] = folder
    point(spark, root, number + 1, batch, tables)
    return number + 1


def change(spark: SparkSession, root: str, table: str, how: Callable[[DataFrame], DataFrame], batch: int | None = None) -> int:
    """Publishes a table as `how` makes it of its newest version: an upsert, a deletion, a transition."""
    number, _ = current(spark, root)
    return publish(spark, root, {table: how(read_version(spark, root, table, number))}, batch, expect=number)


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the folders that the last `keep` versions do not name, what failed writers left among them; how many. No writer may be at work."""
    kept = versions(spark, root).orderBy(F.desc("number"), F.desc("written")).limit(keep).select(F.explode(F.map_values("tables")).alias("folder")).distinct()
    names = {r["folder"].removeprefix("data/") for r in kept.collect()}  # a few tables of a few versions
    data = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    store = data.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in (store.listStatus(data) if store.exists(data) else []) if f.getPath().getName() not in names]
    return sum(store.delete(path, True) for path in gone)
