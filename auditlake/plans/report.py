"""Health reports of all projects: measures, rules, reviews, groups, scores, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as fi
from ..operators import graph, rules, scoring
from ..operators.review import ingest_reviews


def project_tables(files: DataFrame, sizes: DataFrame, min_lines: int = rules.LARGE_FILE, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the rules read: large_files, complex_functions, secret_hits, untested_critical, measures."""
    edges = graph.kept(graph.import_edges(files)) if edges is None else edges
    logic = graph.kept(graph.logic_sources(files))
    exercised = graph.tested_sources(files, graph.reachable(edges))
    conservative = graph.tested_sources(files, graph.reachable(edges, facade_only=True))
    percent = graph.tested_percent(logic, exercised)
    return {
        "large_files": rules.large_files(files, min_lines), "complex_functions": rules.complex_functions(sizes), "secret_hits": rules.secret_hits(files),
        "untested_critical": graph.untested_critical(logic, conservative), "measures": rules.project_measures(files, sizes, percent, min_lines),
    }


def build_reports(files: DataFrame, sizes: DataFrame, claims: DataFrame | None = None, chunks: DataFrame | None = None, min_lines: int = rules.LARGE_FILE, policy: str = "diminishing") -> DataFrame:
    """One row per project: scores by category, health, `summaries` (three sentences) and the grouped `issues`, worst first.

    claims and chunks: what a reviewer claims and was shown; without them the report holds the rules' findings alone.
    """
    tables = project_tables(files, sizes, min_lines)
    found = rules.run_rules(tables, whole=True)
    if claims is not None and chunks is not None:
        reviewed, _ = ingest_reviews(claims, chunks)
        found = fi.all_findings(found, reviewed)
    grouped = fi.group_findings(found)
    scores = scoring.POLICIES[policy](tables["measures"], grouped if policy == "diminishing" else found)
    issue = F.struct(fi.text.severity_rank(F.col("severity")).alias("rank"), "category", "ord", "severity", "title", "description", "file_path", "occurrences")
    issues = grouped.groupBy("project_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"))  # the rules' caps and ten claims of a review bound a project's findings
    said = rules.summaries(tables["measures"]).select("project_id", F.struct("code_quality", "testing", "security").alias("summaries"))
    return scores.hint("merge").join(said.hint("merge"), "project_id").hint("merge").join(issues.hint("merge"), "project_id", "left")
