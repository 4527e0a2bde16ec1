"""Lists of findings: grouped, sorted, filtered, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .rules import GROUPS


def all_findings(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings of rules, then those of reviews: `ord` keeps that order."""
    return rules.unionByName(reviews.withColumns({"rule": F.lit(None).cast("string"), "ord": F.col("ord") + 1_000_000}).select(*rules.columns))


def group_key() -> Column:
    return F.when(F.col("rule").isNotNull(), F.concat(F.lit("rule:"), "rule")).otherwise(F.concat(F.lit("review:"), "category", F.lit(":"), F.lower(F.trim("title"))))


def looked_up(rule: Column, of: int) -> Column:
    return reduce(lambda c, name: c.when(rule == name, GROUPS[name][of]), GROUPS, F.when(F.lit(False), ""))


def group_findings(findings: DataFrame) -> DataFrame:
    """One finding per problem: repetitions of a rule, or of a review's title in a category, become one with its occurrences, worst first.

    A rule's findings are capped per project before they come here, so a group is small.
    """
    occurrence = F.struct(text.severity_rank(F.col("severity")).alias("rank"), "ord", "file_path", "severity", "title", "description")
    first = F.min_by(F.struct("title", "description", "category", "rule"), F.col("ord"))
    g = findings.withColumn("key", group_key()).groupBy("project_id", "key").agg(F.min("ord").alias("ord"), first.alias("first"), F.array_sort(F.collect_list(occurrence)).alias("o"))
    many, worst = F.size("o") > 1, F.element_at("o", 1)
    title = F.coalesce(looked_up(F.col("first.rule"), 0), F.col("first.title"))
    return g.select(
        "project_id", "ord", F.col("first.rule").alias("rule"), F.col("first.category").alias("category"), worst["severity"].alias("severity"),
        F.when(many, F.concat(title, F.lit(" ("), F.size("o").cast("string"), F.lit(")"))).otherwise(F.col("first.title")).alias("title"),
        F.when(many, F.coalesce(looked_up(F.col("first.rule"), 1), F.col("first.description"))).otherwise(F.col("first.description")).alias("description"),
        worst["file_path"].alias("file_path"), F.transform("o", lambda x: F.struct(x["file_path"].alias("file_path"), x["severity"].alias("severity"), x["title"].alias("title"), x["description"].alias("description"))).alias("occurrences"))


def expand_occurrences(grouped: DataFrame) -> DataFrame:
    """One row per occurrence."""
    return grouped.select("project_id", "rule", "category", F.posexplode_outer("occurrences").alias("at", "o")).select("project_id", "rule", "category", "at", "o.*")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("project_id", text.severity_rank(F.col("severity")), F.collate("category", "UNICODE"), "ord")


def filter_issues(findings: DataFrame, severity: str = "all", category: str = "all") -> DataFrame:
    for col, wanted in (("severity", severity), ("category", category)):
        findings = findings if wanted == "all" else findings.filter(F.col(col) == wanted)
    return findings


def count_by_severity(findings: DataFrame) -> DataFrame:
    """project_id and a count for each severity, 0 for none."""
    return findings.groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in text.SEVERITIES])


def findings_by_rule(findings: DataFrame) -> DataFrame:
    """Counts by title with numbers and closing counts taken out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("title", r"\s*\([^)]*\)$", ""), r"\d+", "N"))
    return findings.groupBy("project_id", bare.alias("title")).agg(F.count("*").alias("n"))


def roadmap(findings: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(text.severity_rank(F.col("severity")), "category", "ord")
    return findings.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= n)


def public_issues(findings: DataFrame) -> DataFrame:
    """What a shared report shows of findings: these columns and no others, texts redacted, of the evidence its lines alone.

    `evidence` and `occurrences` may be absent. The quoted code stays private.
    """
    clean = text.redact_public
    shown = ["project_id", clean(F.col("title")).alias("title"), clean(F.col("description")).alias("description"), "severity", "category", "file_path"]
    if "evidence" in findings.columns:
        lines = F.struct(F.col("evidence.start_line").alias("start_line"), F.col("evidence.end_line").alias("end_line"))
        shown.append(F.when(F.col("evidence").isNotNull(), lines).alias("evidence"))
    if "occurrences" in findings.columns:
        one = lambda o: F.struct(o["file_path"].alias("file_path"), o["severity"].alias("severity"), clean(o["title"]).alias("title"), clean(o["description"]).alias("description"))
        shown.append(F.transform("occurrences", one).alias("occurrences"))
    return findings.select(*shown)
