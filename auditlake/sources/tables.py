"""Tables of project files and results: reads that prune, and writes that replace a project or append a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

HEAVY = ("documents", "pages", "conversations", "embeddings")
#: So many rows a task sorts or groups, where `dealt_by` deals them.
TASK_ROWS = 1 << 20
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; of texts and vectors, on whose rows much is done, a file that is too small for several tasks is dealt over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in HEAVY and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, and over no fewer tasks than before: for short rows of which much is made, as their file is small and one row group of it is one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def dealt_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over so many tasks that each has some TASK_ROWS of `rows`; as they are, for Spark to deal, where its own number of shuffle partitions is enough.

    A task's memory so stays where it is while the input grows. What meets in a join or grouping takes one `rows`, all of its rows together.
    """
    n = -(-rows // TASK_ROWS)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


def write_project_files(df: DataFrame, path: str) -> None:
    """Replaces all files of the projects in `df`, and of no other project."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """project_id, path, size_bytes in order; contents are not read."""
    return files.select("project_id", "path", "size_bytes").orderBy("project_id", "path")


def source_files(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_source_file(F.col("path"))).orderBy("project_id", "path")


def read_file(files: DataFrame, project_id: object, path: str) -> DataFrame:
    """One file, by equality on project and path so that both reach the scan; a path that leaves the root finds nothing."""
    plain = "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))
    if path.startswith("/") or ".." in plain.split("/") or "\x00" in path:
        return files.limit(0)
    return files.filter((F.col("project_id") == F.lit(project_id)) & (F.col("path") == plain)).limit(1)


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """repo (the file's folder), date, commit, score, score_v1 of the files <date>-<commit>.json that measured their own repository, in order; without a first score, the current one counts as it."""
    schema = "date string, commit string, analysis struct<thisRepository: struct<deterministicHealthScore: int, v1DeterministicHealthScore: int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    own = F.col("analysis.thisRepository")
    named = raw.filter(F.col("file").rlike(r"/\d{4}-\d{2}-\d{2}-[0-9a-f]+\.json$") & own.isNotNull())
    score = own["deterministicHealthScore"]
    return named.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("repo"), "date", "commit", score.alias("score"), F.coalesce(own["v1DeterministicHealthScore"], score).alias("score_v1")).orderBy("repo", "date", "commit")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """suite, file, kind, id, hits of coverage reports in folders named by suite; paths from `src/` on."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("suite"), F.from_json("value", "map<string,struct<s:map<string,int>,f:map<string,int>>>").alias("m"))
    files = raw.select("suite", F.explode("m").alias("file", "c")).withColumn("file", F.regexp_replace(F.translate("file", "\\", "/"), "^.*?/src/", "src/"))
    of = lambda kind, col: files.select("suite", "file", F.lit(kind).alias("kind"), F.explode(f"c.{col}").alias("id", "hits"))
    return of("statement", "s").unionByName(of("function", "f"))


def stale_objects(spark: SparkSession, prefix: str, before: Column, n: int) -> DataFrame:
    """path, modificationTime of objects last changed before a time; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", "modificationTime")
    return listed.filter(F.col("modificationTime") < before).orderBy("modificationTime", "path").limit(n)


def write_result(df: DataFrame, folder: str, date: str, commit: str) -> None:
    """A run's result in a folder of its own, named by date and commit; an earlier one is never replaced."""
    df.write.mode("errorifexists").json(f"{folder}/{date}-{commit}")


def strip_comments(files: DataFrame, marker: str) -> DataFrame:
    """Files without the comments that hold `marker` (a regular expression); lines keep their numbers."""
    return files.withColumn("content", F.regexp_replace("content", rf"(?m)[ \t]*//[^\n]*(?:{marker})[^\n]*$", ""))
