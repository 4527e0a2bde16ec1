"""The import graph of projects: edges, what tests reach, and what they leave out."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import count

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text


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


def kept(df: DataFrame) -> DataFrame:
    """`df` written to a table in the cluster's shared checkpoint folder and read back, with its lineage cut.

    A table has the size of its files, where a checkpoint keeps an estimate that grows with every join of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def import_edges(files: DataFrame) -> DataFrame:
    """project_id, source, target (module keys), facade, from_test; a test's edges to what it mocks are left out."""
    path = F.col("path")
    seen = files.select("project_id", "path", text.specifiers(F.col("content")).alias("specs"), text.mocks(F.col("content")).alias("mocked"), paths.is_test_file(path).alias("from_test"))
    target = lambda col: paths.module_key(paths.resolve_import(path, F.col(col)))
    edges = seen.select("project_id", "path", "from_test", F.explode("specs").alias("spec")).select("project_id", "path", "from_test", target("spec").alias("target")).filter("target IS NOT NULL").distinct()
    mocked = seen.filter("from_test").select("project_id", "path", F.explode("mocked").alias("spec")).select("project_id", "path", target("spec").alias("target")).distinct()
    real = edges.hint("merge").join(mocked.hint("merge"), ["project_id", "path", "target"], "left_anti")
    return real.select("project_id", paths.module_key(path).alias("source"), "target", paths.is_facade(path).alias("facade"), "from_test").distinct()


def reachable(edges: DataFrame, facade_only: bool = False, most_rounds: int | None = None) -> DataFrame:
    """project_id, node: what tests import, and what that imports in turn, through every file or only through facades.

    Each round joins the frontier alone with the edges and drops what was reached before; it ends when nothing is new.
    Where `most_rounds` is given, a frontier that is left after so many rounds is an error.
    """
    steps = edges.filter("NOT from_test" + (" AND facade" if facade_only else "")).select("project_id", F.col("source").alias("node"), "target")
    frontier = kept(edges.filter("from_test").select("project_id", F.col("target").alias("node")).distinct())
    reached = frontier
    for n in count():
        frontier = kept(frontier.join(steps, ["project_id", "node"]).select("project_id", F.col("target").alias("node")).distinct().join(reached, ["project_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return reached
        if most_rounds is not None and n >= most_rounds:
            raise ValueError(f"more than {most_rounds} rounds of imports")
        reached = kept(reached.unionByName(frontier))


def tested_by_name(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """project_id, path of the sources whose bare path ends with a test's guessed source, or the other way round.

    Either way the shorter one's last segment ends the longer one's, so pairs are joined by the last segment where it
    is whole in both. A shorter one without any slash can end inside a segment: it is looked up among the endings of the others'
    last segments, which are file names and so not long.
    """
    base = sources.select("project_id", "path", paths.strip_ext(F.col("path")).alias("bare"))
    guess = tests.select("project_id", paths.guess_source(F.col("path")).alias("guess")).distinct()
    ends = F.col("guess").endswith(F.col("bare")) | F.col("bare").endswith(F.col("guess"))
    base, guess = base.withColumn("last", paths.basename(F.col("bare"))), guess.withColumn("last", paths.basename(F.col("guess")))
    whole = base.hint("merge").join(guess.hint("merge"), ["project_id", "last"]).filter(ends).select("project_id", "path")
    endings = lambda df: df.withColumn("last", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("last"), F.lit(1))), lambda k: F.substr(F.col("last"), k))))
    flat = lambda df, col: df.filter(~F.col(col).contains("/"))
    named = endings(guess).select("project_id", "last").distinct()
    by_guess = flat(base, "bare").hint("merge").join(named.hint("merge"), ["project_id", "last"], "left_semi").select("project_id", "path")
    by_base = endings(base).hint("merge").join(flat(guess, "guess").select("project_id", "last").hint("merge"), ["project_id", "last"], "left_semi").select("project_id", "path")
    # Everything ends with an empty name.
    empty = lambda df, col: df.filter(F.col(col) == "").select("project_id").distinct()
    by_none = base.hint("merge").join(empty(guess, "guess").hint("merge"), "project_id", "left_semi").select("project_id", "path")
    to_none = flat(base, "bare").filter("bare = ''").hint("merge").join(guess.select("project_id").distinct().hint("merge"), "project_id", "left_semi").select("project_id", "path")
    return whole.unionByName(by_guess).unionByName(by_base).unionByName(by_none).unionByName(to_none).distinct()


# How a declaration of a type begins and ends, and what counts as logic.
OPEN, CLOSE = r"[{(\[<]", r"[})\]>]"
PLAIN = r"[^{}()\[\]<>=]|=>?"
TYPE_DECLARATION = rf"""(?sx)
    (?(DEFINE) (?P<over> {OPEN} (?:{PLAIN}|(?&over))*+ {CLOSE} ) (?P<under> {CLOSE} (?:{PLAIN}|(?&under))*+ {OPEN} ))
    (?:\A|\n) [ \t]* (?:export[ \t]+)? (?:declare[ \t]+)?
    (?: interface [ \t]+ [A-Za-z0-9_] (?: {PLAIN} | {OPEN} (?:{PLAIN}|(?&over))*+ [)\]>] | (?&under) )*+ (?: {OPEN} (?:{PLAIN}|(?&over))*+ \}} | .* )
      | type [ \t]+ [A-Za-z0-9_] (?: [^{{}}()\[\]<>=;\n] | =>? | \n(?=\s*[|&=]) | (?&over) | (?&under) )*+ (?: [;\n] | .* ) )
"""


IMPORT_LINE = r"(^|\n)\s*import[^;\n]*(?:;|\n)"
RE_EXPORT = r"""(^|\n)\s*export\s+(?:type\s+)?(?:\*|\{[^}]*\})(?:\s+as\s+\w+)?\s+from\s+""\s*;?"""
LOGIC = r"=>|\bfunction\b|\bclass\b|\b(?:if|for|while|switch|catch)\s*\(|\btry\s*\{|\bnew\s+\w|\bawait\b|\breturn\b|\bthrow\b"


#: What every declaration of a type begins with, in SQL's expressions.
TYPE_BEGIN = r"(^|\n)[ \t]*(export[ \t]+)?(declare[ \t]+)?(interface|type)[ \t]+[A-Za-z0-9_]"


@F.arrow_udf(T.StringType())
def typeless(code: pa.Array) -> pa.Array:
    """Code without its declarations of interfaces and types: brackets nest, so the grammar is a recursive expression, which SQL's lack.

    An interface ends with its body; a type at a semicolon, or at a line break outside brackets that the next line does
    not continue; without such an end, either takes the rest. Few texts at a time are Python's.
    """
    declaration = regex.compile(TYPE_DECLARATION)
    bare = lambda c: None if c is None else declaration.sub("", c)
    parts = [pa.array([bare(c) for c in code.slice(i, 64).to_pylist()], pa.string()) for i in range(0, len(code), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def has_logic(content: Column) -> Column:
    """Functions, classes or control flow left once imports, re-exports and type declarations are gone.

    Only texts in which a declaration of a type begins go through Python.
    """
    code = text.code_only(content)
    declares = (code.contains("interface") | code.contains("type")) & code.rlike(TYPE_BEGIN)
    code = F.regexp_replace(F.coalesce(typeless(F.when(declares, code)), code), IMPORT_LINE, "$1")
    code = F.regexp_replace(code, RE_EXPORT, "$1")
    return code.rlike(LOGIC)


def logic_sources(files: DataFrame) -> DataFrame:
    return files.filter(~paths.is_test_file(F.col("path"))).filter(has_logic(F.col("content"))).select("project_id", "path")


def tested_sources(files: DataFrame, reached: DataFrame) -> DataFrame:
    """project_id, path of the sources that are reached or named by a test."""
    is_test = paths.is_test_file(F.col("path"))
    sources, tests = files.filter(~is_test).select("project_id", "path"), files.filter(is_test).select("project_id", "path")
    hit = sources.withColumn("node", paths.module_key(F.col("path"))).hint("merge").join(reached.hint("merge"), ["project_id", "node"], "left_semi").select("project_id", "path")
    return hit.unionByName(tested_by_name(sources, tests)).distinct()


def tested_percent(logic: DataFrame, tested: DataFrame) -> DataFrame:
    """project_id, tested_percent: the share of files with logic that tests exercise, rounded."""
    marked = logic.hint("merge").join(tested.withColumn("hit", F.lit(1)).hint("merge"), ["project_id", "path"], "left")
    return marked.groupBy("project_id").agg(text.half_up(100 * F.count("hit") / F.count("*")).cast("int").alias("tested_percent"))


def untested_critical(logic: DataFrame, tested: DataFrame) -> DataFrame:
    """project_id, path of the first dozen files of critical areas that no test covers."""
    from .rules import CAPS, top_n

    return top_n(logic.filter(paths.is_critical(F.col("path"))).hint("merge").join(tested.hint("merge"), ["project_id", "path"], "left_anti"), ["project_id"], [F.col("path")], CAPS["untested-listed"])
