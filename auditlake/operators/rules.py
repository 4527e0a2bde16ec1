"""Measures of projects and the deterministic rules on them.

Tables: files (project_id, path, content), sizes (project_id, file_path, name, lines), findings (project_id, ord,
rule, category, severity, title, description, file_path).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

LARGE_FILE, VERY_LARGE_FILE, LONG_FUNCTION, COMPLEX_FUNCTION, VERY_COMPLEX_FUNCTION = 400, 800, 50, 80, 150
CAPS = {"large-file": 10, "complex-function": 12, "untested-critical-path": 8, "hardcoded-secret": 10, "untested-listed": 12}


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark prunes groups before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def large_files(files: DataFrame, min_lines: int = LARGE_FILE) -> DataFrame:
    """project_id, path, lines of the source files with many lines."""
    return files.filter(~paths.is_test_file(F.col("path"))).select("project_id", "path", text.line_count(F.col("content")).alias("lines")).filter(F.col("lines") >= min_lines)


def function_measures(sizes: DataFrame, long: int = LONG_FUNCTION) -> DataFrame:
    """project_id, function_count, long_function_count, without tests."""
    return sizes.filter(~paths.is_test_file(F.col("file_path"))).groupBy("project_id").agg(F.count("*").alias("function_count"), F.count_if(F.col("lines") > long).alias("long_function_count"))


def complex_functions(sizes: DataFrame, min_lines: int = COMPLEX_FUNCTION) -> DataFrame:
    return sizes.filter(~paths.is_test_file(F.col("file_path")) & (F.col("lines") >= min_lines)).select("project_id", "file_path", "name", "lines")


def secret_hits(files: DataFrame) -> DataFrame:
    """project_id, path, line, hint: each line's first matching pattern; tests and fixtures do not count."""
    own = files.filter(~paths.is_test_file(F.col("path")) & ~paths.is_test_support(F.col("path"))).filter(text.may_hold_secret(F.col("content")))
    lines = own.select("project_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("at", "line_text"))
    return lines.select("project_id", "path", (F.col("at") + 1).alias("line"), text.secret_hint(F.col("line_text")).alias("hint")).filter("hint IS NOT NULL")


def project_measures(files: DataFrame, sizes: DataFrame, tested: DataFrame, min_lines: int = LARGE_FILE) -> DataFrame:
    """One row per project. `tested`: project_id, tested_percent."""
    is_test = paths.is_test_file(F.col("path"))
    counts = files.groupBy("project_id").agg(F.count_if(is_test).alias("test_file_count"), F.count_if(~is_test).alias("source_file_count"))
    parts = [
        function_measures(sizes), complex_functions(sizes).groupBy("project_id").agg(F.count("*").alias("complex_function_count")),
        large_files(files, min_lines).groupBy("project_id").agg(F.count("*").alias("large_file_count")), secret_hits(files).groupBy("project_id").agg(F.count("*").alias("secret_hit_count")), tested,
    ]
    whole = reduce(lambda a, b: a.hint("merge").join(b.hint("merge"), "project_id", "left"), parts, counts)
    return whole.na.fill(0, ["function_count", "long_function_count", "complex_function_count", "large_file_count", "secret_hit_count", "tested_percent"])


# Fixed values, from here on: the sentences of reports and findings.


def summaries(measures: DataFrame) -> DataFrame:
    """project_id and one sentence each on code quality, testing and security."""
    return measures.select(
        "project_id",
        F.format_string("%d of %d function(s) have more than 50 lines (%d with 80+); %d large file(s).", "long_function_count", "function_count", "complex_function_count", "large_file_count").alias("code_quality"),
        F.format_string("Matched test files for roughly %d%% of source files (%d test files found).", F.col("tested_percent").cast("int"), "test_file_count").alias("testing"),
        F.format_string("Pattern scan found %d potential hardcoded secret hit(s).", "secret_hit_count").alias("security"))


def finding(df: DataFrame, rule: str, category: str, severity: Column, title: Column, description: Column, file_path: Column, ord_: Column) -> DataFrame:
    return df.select("project_id", ord_.cast("int").alias("ord"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"), title.alias("title"), description.alias("description"), file_path.cast("string").alias("file_path"))


def rule_large_file(large: DataFrame, very: int = VERY_LARGE_FILE) -> DataFrame:
    top = top_n(large, ["project_id"], [F.desc("lines"), F.col("path")], CAPS["large-file"])
    return finding(top, "large-file", "codeQuality", F.when(F.col("lines") >= very, "high").otherwise("medium"), F.format_string("Large file (%d lines)", "lines"), F.lit("This file is unusually large and may be harder to maintain. Consider splitting responsibilities."), F.col("path"), F.col("rank"))


def rule_complex_function(complex_: DataFrame) -> DataFrame:
    top = top_n(complex_, ["project_id"], [F.desc("lines"), F.col("file_path"), F.col("name")], CAPS["complex-function"])
    return finding(top, "complex-function", "codeQuality", F.when(F.col("lines") >= VERY_COMPLEX_FUNCTION, "high").otherwise("medium"), F.format_string("Complex function %s (%d lines)", "name", "lines"), F.lit("Function appears long and may have high complexity. Consider extracting helpers."), F.col("file_path"), F.col("rank"))


def rule_low_coverage(measures: DataFrame) -> DataFrame:
    low = measures.filter("tested_percent < 40")
    said = F.format_string("Only about %d%% of source files appear to have nearby test files. This is a file-matching proxy, not runtime coverage.", F.col("tested_percent").cast("int"))
    return finding(low, "low-test-coverage", "testing", F.when(F.col("tested_percent") < 15, "high").otherwise("medium"), F.lit("Low test file coverage signal"), said, F.lit(None), F.lit(1))


def rule_untested_critical(listed: DataFrame) -> DataFrame:
    top = top_n(listed, ["project_id"], [F.col("path")], CAPS["untested-critical-path"])
    return finding(top, "untested-critical-path", "testing", F.lit("high"), F.lit("Critical area may lack tests"), F.lit("No nearby test file was found for a path that looks security/payment related."), F.col("path"), F.col("rank"))


def rule_secret(hits: DataFrame) -> DataFrame:
    top = top_n(hits, ["project_id"], [F.col("path"), F.col("line")], CAPS["hardcoded-secret"])
    said = F.format_string("%s around line %d. Treat as a potential issue to review, not a confirmed vulnerability.", "hint", "line")
    return finding(top, "hardcoded-secret", "security", F.lit("critical"), F.lit("Potential hardcoded secret"), said, F.col("path"), F.col("rank"))


#: rule -> (title, description) of the finding that stands for several.
GROUPS = {
    "large-file": ("Large files", "These files are unusually large and may be harder to maintain. Consider splitting responsibilities."),
    "complex-function": ("Complex functions", "These functions appear long and may have high complexity. Consider extracting helpers."),
    "low-test-coverage": ("Low test file coverage signal", "Few source files appear to have nearby test files. This is a file-matching proxy, not runtime coverage."),
    "untested-critical-path": ("Critical areas may lack tests", "No nearby test file was found for these paths that look security/payment related."),
    "hardcoded-secret": ("Potential hardcoded secrets", "Possible credentials in the source. Treat each as a potential issue to review, not a confirmed vulnerability."),
}
#: In report order: name -> (table it reads, rule). Callers add their own.
RULES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "large-file": ("large_files", rule_large_file), "complex-function": ("complex_functions", rule_complex_function), "low-test-coverage": ("measures", rule_low_coverage),
    "untested-critical-path": ("untested_critical", rule_untested_critical), "hardcoded-secret": ("secret_hits", rule_secret),
}


def run_rules(tables: dict[str, DataFrame], rules: dict | None = None, whole: bool = False) -> DataFrame:
    """The findings of the rules whose table is given, or of all, where `whole` makes an absent table an error; `ord` counts on in rule order."""
    absent = sorted({table for table, _ in (rules or RULES).values()} - set(tables))
    if whole and absent:
        raise ValueError(f"rules without their table: {', '.join(absent)}")
    parts = [rule(tables[table]).withColumn("ord", F.col("ord") + 1000 * i) for i, (table, rule) in enumerate((rules or RULES).values()) if table in tables]
    return reduce(DataFrame.unionByName, parts)
