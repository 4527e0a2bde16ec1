"""Category and health scores of projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

CATEGORIES = ["architecture", "security", "performance", "codeQuality", "testing"]


def finding_penalty(grouped: DataFrame) -> DataFrame:
    """`penalty` of grouped findings: the worst occurrence in full, each further one half of the one before."""
    halved = F.aggregate(
        "occurrences", F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("part")),
        lambda a, o: F.struct((a["sum"] + text.severity_penalty(o["severity"]) * a["part"]).alias("sum"), (a["part"] / 2).alias("part")), lambda a: a["sum"])
    return grouped.withColumn("penalty", F.when(F.size("occurrences") > 0, halved).otherwise(text.severity_penalty(F.col("severity")).cast("double")))


def category_bases(measures: DataFrame) -> DataFrame:
    """project_id and a base for each category."""
    long_share = F.when(F.col("function_count") == 0, 0.0).otherwise(100.0 * F.col("long_function_count") / F.col("function_count"))
    return measures.select(
        "project_id", F.lit(88.0).alias("architecture"), F.when(F.col("secret_hit_count") > 0, 70.0).otherwise(90.0).alias("security"), F.lit(86.0).alias("performance"),
        (100 - 4 * long_share).alias("codeQuality"), F.when(F.col("test_file_count") == 0, 0.0).otherwise(40 + 0.6 * F.col("tested_percent")).alias("testing"))


def v1_bases(measures: DataFrame) -> DataFrame:
    return measures.select(
        "project_id", F.lit(88.0).alias("architecture"), F.when(F.col("secret_hit_count") > 0, 70.0).otherwise(90.0).alias("security"), F.lit(86.0).alias("performance"),
        F.when(F.col("large_file_count") + F.col("complex_function_count") > 8, 72.0).otherwise(85.0).alias("codeQuality"), F.greatest(F.lit(40.0), F.col("tested_percent").cast("double")).alias("testing"))


def less_penalties(bases: DataFrame, charged: DataFrame) -> DataFrame:
    """Scores by category: the base less the sum of `penalty`, from 0 to 100; and the health score, their mean."""
    sums = charged.groupBy("project_id").agg(*[F.sum(F.when(F.col("category") == c, F.col("penalty")).otherwise(0.0)).alias(f"_{c}") for c in CATEGORIES])
    joined = bases.hint("merge").join(sums.hint("merge"), "project_id", "left")
    scored = joined.select("project_id", *[text.clamp_score(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in CATEGORIES])
    return scored.withColumn("health", health())


def health() -> Column:
    return text.clamp_score(sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])) / 5)


def diminishing_scores(measures: DataFrame, grouped: DataFrame) -> DataFrame:
    """The current policy, on grouped findings. Code-quality findings of rules are shown but not charged: the base measures them."""
    charged = finding_penalty(grouped).filter(~((F.col("category") == "codeQuality") & F.col("rule").isNotNull()))
    return less_penalties(category_bases(measures), charged)


def linear_scores(measures: DataFrame, findings: DataFrame) -> DataFrame:
    """The first policy, on findings that are not grouped: every one is charged in full."""
    return less_penalties(v1_bases(measures), findings.withColumn("penalty", text.severity_penalty(F.col("severity")).cast("double")))


POLICIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"diminishing": diminishing_scores, "linear": linear_scores}
