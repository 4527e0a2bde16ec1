"""Every registered query of the library with SQL, against DuckDB; and results that must not depend on partitioning."""

import math
import os
import re

import pytest

from auditlake.operators import evals
from auditlake.plans.queries import ORACLE_SQL, QUERIES
from auditlake.sources import tables

from .oracle import DATA, by_duckdb, by_spark

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert by_spark(QUERIES[name](spark, DATA)) == by_duckdb(ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["w9_review_sample", "c4_chunk_corpus", "a16_health", "w7_round_robin", "t1_rate_limit"])
def test_partitioning_does_not_matter(spark, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(by_spark(QUERIES[name](spark, DATA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0][1]


def tasks_by_keys(df):
    """The keys and the number of tasks of every shuffle in the plan."""
    found = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    return {(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in found}


def test_package_sizes_takes_more_tasks_for_more_rows(spark, monkeypatch):
    rows, name = tables.read_table(spark, DATA, "lineitem").count(), "a34_package_sizes"
    monkeypatch.setattr(tables, "TASK_ROWS", 250)
    df = QUERIES[name](spark, DATA)
    assert ("bundle, path", math.ceil(rows / 250)) in tasks_by_keys(df)
    assert by_spark(df) == by_duckdb(ORACLE_SQL[name])


def test_package_sizes_counts_files_by_itself(spark, monkeypatch):
    files = spark.createDataFrame([("b", f"/x/node_modules/p{k % 3}/f{k % 40}", k % 40) for k in range(120)], "bundle string, path string, bytes long")
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    df = evals.package_sizes(files)
    assert ("bundle, path", 12) in tasks_by_keys(df)
    assert sorted(map(tuple, df.collect())) == [("b", "p0", 780, 1), ("b", "p1", 780, 2), ("b", "p2", 780, 3)]


@pytest.mark.parametrize(("name", "grouped"), [("j19_classify_citations", set()), ("a31_grounding_metrics", {"repo, question"})])
def test_citations_take_more_tasks_for_more_rows(spark, monkeypatch, name, grouped):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    df = QUERIES[name](spark, DATA)
    few = {keys for keys, n in tasks_by_keys(df) if n <= 4}
    many = {keys for keys, n in tasks_by_keys(df) if n > 20}
    assert many == {"repo, question, as", "repo, as"} | grouped and few <= {"repo"}
    assert by_spark(df) == by_duckdb(ORACLE_SQL[name])


def test_grounding_metrics_counts_by_itself(spark, monkeypatch):
    answers = spark.createDataFrame([("r", q, q != 2, "All is well.", ["src/a.ts"]) for q in range(3)], "repo string, question int, answerable boolean, answer string, expected array<string>")
    cited = spark.createDataFrame([("r", 0, "a.ts"), ("r", 0, "src/b.ts"), ("r", 0, "none.ts"), ("r", 1, "b.ts"), (None, 1, "b.ts")], "repo string, question int, as string")
    retrieved = spark.createDataFrame([("r", 0, "src/a.ts"), ("r", 0, "src/a.ts")], "repo string, question int, path string")
    known = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/b.ts"), ("r", "src/b.ts")], "repo string, path string")
    found = []
    for most in (1 << 20, 1):
        monkeypatch.setattr(tables, "TASK_ROWS", most)
        kinds = evals.classify_citations(cited, retrieved, known)
        assert {n for keys, n in tasks_by_keys(kinds) if keys == "repo, as"} == {4 if most > 1 else 5 + 2 * (2 + 3)}
        metrics = evals.grounding_metrics(answers, kinds)
        assert {n for keys, n in tasks_by_keys(metrics) if keys == "repo, question"} == {4 if most > 1 else 3 + 5}
        found.append((by_spark(kinds), [tuple(r) for r in metrics.collect()]))
    assert found[0] == found[1]
    assert sorted(map(tuple, kinds.select("question", "as", "kind").filter("repo = 'r'").collect())) == [(0, "a.ts", "retrieved"), (0, "none.ts", "unknown"), (0, "src/b.ts", "unseen"), (1, "b.ts", "unseen")]
    assert found[0][1] == [("r", 3, pytest.approx((0.5 + 0 + 1) / 3), 0.5, 0.0, ["b.ts", "src/b.ts"])]
