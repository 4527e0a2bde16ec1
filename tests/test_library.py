"""The library's own operators on small in-line tables."""

import datetime as dt
import io
import json
import math
import random
import re
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from auditlake.functions import paths, text
from auditlake.operators import chunks, evals, findings, graph, lifecycle, quantiles, review, rules, scoring, search, usage, vectors
from auditlake.plans import operator_queries
from auditlake.plans.report import build_reports
from auditlake.sources import archives, tables
from auditlake.streaming import jobs

FILES = "project_id string, path string, content string"


def one(spark, made, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(made.alias("x")).first()[0]


@pytest.mark.parametrize(
    "path, kept",
    [("src/a.ts", True), ("node_modules/x/a.ts", False), ("a/../b.ts", False), ("/etc/a.ts", False), ("C:/a.ts", False), ("vendor/a.ts", False), ("src/vendor/a.ts", True), ("app/assets/vendor/a.ts", False), (".env.local", False), ("keys/id_rsa", False), ("x.PEM", False), ("a.min.js", False), ("logo.PNG", False), ("./src//b.ts", True), ("dir/", False), ("Yarn.lock", False)],
)
def test_keep_path(spark, path, kept):
    assert one(spark, paths.keep_path(F.col("p")), p=path) is kept


def test_paths_and_text(spark):
    assert one(spark, paths.path_words(F.col("p")), p="src/lib/oauthIcons.tsx") == ["src", "lib", "oauth", "icons", "tsx"]
    assert one(spark, paths.resolve_import(F.col("p"), F.col("s")), p="src/app/x.ts", s="../../lib/./db.ts") == "lib/db"
    assert one(spark, paths.resolve_import(F.col("p"), F.col("s")), p="a.ts", s="@/lib/db") == "src/lib/db"
    assert one(spark, paths.resolve_import(F.col("p"), F.col("s")), p="a.ts", s="react") is None
    assert one(spark, text.fnv1a32(F.col("t")), t="") == "811c9dc5" and one(spark, text.fnv1a32(F.col("t")), t="a") == "e40c292c"
    assert one(spark, text.collapse_ws(F.col("t")), t="  a\u00a0\n b ") == "a b"
    assert one(spark, text.norm_path(F.col("t")), t=" NULL ") is None
    secret = "pass" + "word = 'hunter22'"
    assert one(spark, text.redact_public(F.col("t")), t=secret) == "password = '[REDACTED]'"
    assert one(spark, text.redact(F.col("t")), t="postgres://u:p@h/db Bearer abc.def") == "postgres://[REDACTED]@h/db Bearer [REDACTED]"
    assert one(spark, text.citations(F.col("t")), t="See ./src/a‑b.ts and node.js, src/a-b.ts.") == ["src/a-b.ts"]
    assert one(spark, text.abstains(F.col("t")), t="The snippets don’t show it.") is True
    assert one(spark, text.specifiers(F.col("t")), t='import a from "./a";\nexport * from "./b";\nconst c = require("c");\n"import x from \'no\'"') == ["./a", "./b", "c"]
    assert one(spark, text.clamp_score(F.lit(86.5)), t="") == 87
    assert spark.sql("SELECT map('apiKey', 'k', 'note', 'Bearer zzz') AS m").select(text.sanitize_fields(F.col("m"))).first()[0] == {"apiKey": "[REDACTED]", "note": "Bearer [REDACTED]"}


def test_measures_rules_and_scores(spark):
    key = "api" + "Key = '0123456789'"
    files = spark.createDataFrame([("p", f"src/f{i}.ts", "x\n" * (420 + i)) for i in range(11)] + [("p", "src/s.ts", f"a\n{key}\n"), ("p", "test/s.ts", key), ("p", "fixtures/s.ts", key), ("q", "a.ts", "")], FILES)
    sizes = spark.createDataFrame([("p", "src/f.ts", f"g{i}", 87) for i in range(12)] + [("p", "src/f.ts", "big", 162), ("p", "a.test.ts", "t", 900)], "project_id string, file_path string, name string, lines int")
    large = rules.large_files(files)
    assert large.count() == 11 and rules.rule_large_file(large).count() == 10
    assert [(r["path"], r["line"]) for r in rules.secret_hits(files).collect()] == [("src/s.ts", 2)]
    assert rules.rule_complex_function(rules.complex_functions(sizes)).filter("severity = 'high'").count() == 1
    measures = rules.project_measures(files, sizes, spark.createDataFrame([("p", 50)], "project_id string, tested_percent int"))
    found = rules.run_rules({"large_files": large, "complex_functions": rules.complex_functions(sizes), "secret_hits": rules.secret_hits(files), "measures": measures})
    grouped = findings.group_findings(found)
    by = {r["rule"]: r for r in grouped.filter("project_id = 'p'").collect()}
    assert by["complex-function"]["title"] == "Complex functions (12)" and by["complex-function"]["severity"] == "high" and by["hardcoded-secret"]["title"] == "Potential hardcoded secret"
    penalty = {r["rule"]: r["penalty"] for r in scoring.finding_penalty(grouped.filter("project_id = 'p'")).collect()}
    assert penalty["complex-function"] == 12 + sum(6 * 0.5**i for i in range(1, 12)) and penalty["hardcoded-secret"] == 20
    score = {r["project_id"]: r for r in scoring.diminishing_scores(measures, grouped).collect()}
    assert score["p"]["security"] == 50 and score["p"]["codeQuality"] == 0 and score["p"]["testing"] == 70 and score["q"]["testing"] == 0
    assert findings.expand_occurrences(grouped).count() == found.count()
    assert findings.sort_findings(grouped).count() == grouped.count() and findings.filter_issues(found, "critical").count() == 1
    assert scoring.linear_scores(measures, found).filter("project_id = 'p'").first()["codeQuality"] == 0


def test_all_rules_run(spark, tmp_path):
    docs = [(1, "x\n" * 70, "en", "s"), (2, "x\n" * 90, "en", "s"), (3, "x\n" * 160, "en", "s"), (4, None, "de", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sf_dir = __spark_entry__.queries(), str(tmp_path)
    found = {(r["project_id"], r["rule"], r["ord"], r["severity"], r["file_path"]) for r in queries["u2_run_rules_all"](spark, sf_dir).collect() if r["rule"] != "large-file"}
    assert found == {("s", "complex-function", 1001, "high", "en/doc_3.ts"), ("s", "complex-function", 1002, "medium", "en/doc_2.ts"), ("s", "low-test-coverage", 2001, "high", None), ("t", "low-test-coverage", 2001, "high", None)}
    assert {r["project_id"]: (r["codeQuality"], r["testing"]) for r in queries["a17_linear_scores_all"](spark, sf_dir).collect()} == {"s": (85 - 2 * 12 - 6 - 12 - 6, 28), "t": (85, 28)}
    with pytest.raises(ValueError, match="complex_functions, measures"):
        rules.run_rules({"large_files": None, "secret_hits": None, "untested_critical": None}, whole=True)


def test_import_graph_and_report(spark):
    rows = [
        ("p", "src/auth/login.ts", 'import { db } from "../db";\nexport function login() { return db; }'), ("p", "src/db.ts", "export const db = () => 1;"), ("p", "src/billing/pay.ts", "export async function pay() { await 1 }"),
        ("p", "src/types.ts", "export interface A { f(): void }\nexport type B = { x: 1 } | {\n y: 2 };\n"), ("p", "src/m/index.ts", 'export * from "./inner";'), ("p", "src/m/inner.ts", "export const f = () => 2;"),
        ("p", "tests/all.test.ts", 'import { login } from "@/auth/login";\nimport { m } from "../src/m";\nvi.mock("../src/billing/pay");\nimport "../src/billing/pay";'),
    ]
    files = spark.createDataFrame(rows, FILES)
    edges = graph.import_edges(files)
    assert {(r["source"], r["target"]) for r in edges.filter("from_test").collect()} == {("tests/all.test", "src/auth/login"), ("tests/all.test", "src/m")}
    assert {r["node"] for r in graph.reachable(edges).collect()} == {"src/auth/login", "src/m", "src/db", "src/m/inner"}
    assert {r["node"] for r in graph.reachable(edges, facade_only=True).collect()} == {"src/auth/login", "src/m", "src/m/inner"}
    logic = {r["path"] for r in graph.logic_sources(files).collect()}
    assert logic == {"src/auth/login.ts", "src/db.ts", "src/billing/pay.ts", "src/m/inner.ts"}
    sizes = spark.createDataFrame([("p", "src/db.ts", "db", 1)], "project_id string, file_path string, name string, lines int")
    claims = spark.createDataFrame([("p", 1, "security", "high", "Open", "d", "src/db.ts", "export  const db"), ("p", 2, "security", "critical", "Wide", "d", "null", None), ("p", 3, "testing", "low", "Gone", "d", "src/db.ts", "nothing like it")], "project_id string, ord int, category string, severity string, title string, description string, file_path string, quote string")
    seen = files.select("project_id", F.col("path").alias("file_path"), "content", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    report = build_reports(files, sizes, claims, seen).first()
    assert report["testing"] == 40 + 45 - 12 and [i["title"] for i in report["issues"]] == ["Open", "Critical area may lack tests", "Wide"]
    found, dropped = review.verify_evidence(claims, seen)
    got = {r["ord"]: r for r in found.collect()}
    assert got[1]["evidence"]["start_line"] == 1 and got[2]["severity"] == "medium" and [r["ord"] for r in dropped.collect()] == [3]


def test_reachable_ends_with_its_frontier(spark):
    rows = [("p", "t", "n0", False, True)] + [("p", f"n{i}", f"n{i + 1}", False, False) for i in range(3)]
    edges = spark.createDataFrame(rows, "project_id string, source string, target string, facade boolean, from_test boolean")
    assert {r["node"] for r in graph.reachable(edges).collect()} == {r["node"] for r in graph.reachable(edges, most_rounds=3).collect()} == {"n0", "n1", "n2", "n3"}
    with pytest.raises(ValueError, match="more than 2 rounds"):
        graph.reachable(edges, most_rounds=2)


def test_chunks(spark):
    long = "".join(f"line {i}\n" for i in range(500))
    files = spark.createDataFrame([("p", "a.ts", long), ("p", "b.ts", "  \n"), ("p", "c.ts", "let a = 1;\nlet b = 2;\n")], FILES)
    pieces = chunks.split_text(files.filter("path = 'a.ts'")).orderBy("seq").collect()
    assert pieces[0]["start_line"] == 1 and pieces[1]["start_line"] == long[:1400].count("\n") + 1 and [len(p["content"]) for p in pieces[:2]] == [len(long[:1600].rstrip()), len(long[1400:3000].rstrip())]
    spans = spark.createDataFrame([("p", "c.ts", "lexical_declaration", 0, 10, 1, 1), ("p", "c.ts", "lexical_declaration", 0, 10, 1, 1), ("p", "c.ts", "expression_statement", 11, 21, 2, 2), ("p", "c.ts", "lexical_declaration", 11, 21, 2, 2)], "project_id string, file_path string, node_type string, start_offset int, end_offset int, start_line int, end_line int")
    out = {(r["file_path"], r["seq"]): r for r in chunks.chunk_corpus(files, spans).collect()}
    assert out["c.ts", 0]["content"] == "let a = 1;\n\nlet b = 2;" and (out["c.ts", 0]["start_line"], out["c.ts", 0]["end_line"]) == (1, 2) and not any(k[0] == "b.ts" for k in out)


def test_review_sample(spark):
    rows = [("p", f"src/{d}/{n}.ts", f"code {d}{n}" + (" req.body" if d == "z" else ""), 1, 2) for d in "abz" for n in range(3)] + [("p", "x.test.ts", "t", 1, 1), ("p", "big.ts", "y" * 30_000, 1, 1), ("q", "only.test.ts", "t", 1, 1)]
    c = spark.createDataFrame(rows, "project_id string, file_path string, content string, start_line int, end_line int")
    sample = review.review_sample(c, max_n=4).collect()
    assert [r["file_path"] for r in sorted((r for r in sample if r["project_id"] == "p"), key=lambda r: r["queue"])] == ["src/z/0.ts", "src/z/1.ts", "src/z/2.ts", "big.ts"]
    assert [r["file_path"] for r in sample if r["project_id"] == "q"] == ["only.test.ts"]
    assert {r["file_path"] for r in review.review_sample(c, max_chars=500).filter("project_id = 'p'").collect()} == {"src/z/0.ts", "src/z/1.ts"}


def test_vectors(spark):
    drafts = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "project_id string, content string")
    stored = spark.createDataFrame([("p", "a", "m", [9.0, 9.0])], "project_id string, content string, embedding_model string, embedding array<float>").withColumn("content_hash", text.content_hash(F.col("content"))).drop("content")
    model = lambda texts: [[float(i), float(i)] for i, _ in enumerate(texts)]
    fresh = vectors.embed_missing(drafts, stored, stored.limit(0), "m", model, 2)
    assert fresh.count() == 1
    out = vectors.reuse_vectors(drafts, vectors.known_embeddings(stored, stored.limit(0), "m"), fresh)
    assert out.filter("reused").count() == 1 and out.filter("embedding IS NULL").count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.embed_missing(drafts, stored, stored.limit(0), "other", model, 3).collect()
    axis = spark.createDataFrame([("p", i, [float(i == j) for j in range(4)]) for i in range(4)], "project_id string, chunk_id int, embedding array<float>")
    top = vectors.vector_topk(axis.filter("chunk_id = 2").withColumnRenamed("chunk_id", "query_id"), axis, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in top] == [(2, 1.0), (0, 0.0)]


def test_evals(spark):
    f = spark.createDataFrame([("c", 1, "security", "a.ts", "Hardcoded secret"), ("c", 2, "security", "a.ts", "Hardcoded secret"), ("c", 3, "testing", "b.ts", "x")], "case string, ord int, category string, file_path string, title string")
    e = spark.createDataFrame([("c", 1, "security", "a.ts", "(?i)secret"), ("d", 2, "security", "z.ts", "q")], "case string, ord int, category string, file_path string, title_regex string")
    m = evals.match_expected(f, e)
    assert [(r["finding_ord"], r["expected_ord"]) for r in m.collect()] == [(1, 1)]
    got = {r["case"]: (r["precision"], r["recall"]) for r in evals.precision_recall(spark.createDataFrame([("c",), ("d",), ("e",)], "case string"), f, e, m).collect()}
    assert got["e"] == (1.0, 1.0)
    assert got["c"] == (1 / 3, 1.0) and got["d"] == (1.0, 0.0) and got[None] == (1 / 3, 0.5)
    keys = spark.createDataFrame([("c", 1, ["a"]), ("c", 2, ["a", "b"]), ("d", 1, []), ("d", 2, [])], "case string, run int, keys array<string>")
    assert {r["case"]: r["stability"] for r in evals.stability(keys).collect()} == {"c": 0.5, "d": 1.0}


def test_stability_reads_every_turn(spark, tmp_path):
    turns = [(1, i, "user", "a" if i < 4 else "b") for i in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = __spark_entry__.queries()["a30_stability_whole"](spark, str(tmp_path)).collect()
    assert row["case"] == "1" and row["stability"] == pytest.approx(7 / 15)


def test_archives(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("root/src/a.ts", "let a = 1;")
        z.writestr("root/src/gen.ts", "let g = 1;")
        z.writestr("root/big.ts", "x" * (archives.MAX_FILE_BYTES + 5))
        z.writestr("root/.gitignore", "gen.ts\n!keep.ts\n# no\n")
        z.writestr("root/package.json", json.dumps({"dependencies": {"next": "1", "react": "2"}}))
    (tmp_path / "p.zip").write_bytes(body.getvalue())
    (tmp_path / "other").mkdir()
    (tmp_path / "other/p.zip").write_bytes(body.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"nonsense")
    entries = archives.strip_common_root(archives.read_archives(spark, str(tmp_path)))
    verdicts = {r["project_id"]: r for r in archives.import_verdict(entries).collect()}
    assert verdicts["p"]["ok"] and verdicts["p"]["skipped_large"] == 1 and verdicts["bad"]["error"] == "corrupt archive"
    assert verdicts["other/p"]["ok"] and verdicts["p"]["total_bytes"] == 20 + len(json.dumps({"dependencies": {"next": "1", "react": "2"}}))
    files = archives.decode_text(entries).filter("project_id = 'p'")
    ignored = {r["project_id"]: r["total_bytes"] for r in archives.import_verdict(entries, archives.ignore_patterns(files)).collect()}
    assert ignored["p"] == verdicts["p"]["total_bytes"] - 10 and ignored["other/p"] == verdicts["p"]["total_bytes"]
    kept = archives.apply_ignore(files, archives.ignore_patterns(files))
    assert {r["path"] for r in kept.collect()} == {"src/a.ts", ".gitignore", "package.json"}
    assert archives.detect_framework(files, files.select("project_id", "path")).first()["framework"] == "Next.js"
    tree = archives.file_tree(spark.createDataFrame([("p", "src/b.ts"), ("p", "a.ts")], "project_id string, path string")).orderBy("parent", "place").collect()
    assert [(r["path"], r["type"]) for r in tree] == [("src", "dir"), ("a.ts", "file"), ("src/b.ts", "file")]
    tables.write_project_files(kept.select("project_id", "path", "content", "size_bytes"), str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert tables.read_file(stored, "p", "src/./a.ts").count() == 1 and tables.read_file(stored, "p", "../a.ts").count() == 0


def test_results_and_coverage(spark, tmp_path):
    for name, own in (("2026-01-01-aaaa", {"deterministicHealthScore": 80, "v1DeterministicHealthScore": 60}), ("2025-12-31-bbbb", {"deterministicHealthScore": 50}), ("notes", {"deterministicHealthScore": 1}), ("2025-01-01-cccc", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"date": name[:10], "commit": name[11:], "analysis": {"thisRepository": own} if own else {}}, indent=1))
    trend = evals.score_trend(tables.read_eval_results(spark, str(tmp_path))).orderBy("date").collect()
    assert [(r["score"], r["score_v1"], r["change"]) for r in trend] == [(50, 50, None), (80, 60, 30)]
    (tmp_path / "unit").mkdir()
    (tmp_path / "unit/coverage-final.json").write_text(json.dumps({"/w/src/a.ts": {"s": {"0": 1, "1": 0}, "f": {"0": 0}}}))
    total, idle = evals.merge_coverage(tables.read_coverage(spark, str(tmp_path / "unit")))
    assert total.first()["statements_percent"] == 50 and idle.first()["file"] == "src/a.ts"


def test_usage_and_lifecycle(spark):
    calls = spark.createDataFrame([(1, "openai/gpt-oss-120b", 5500, 1400), (2, "none", 1, 1)], "user_id int, model string, input_tokens long, output_tokens long")
    assert {r["user_id"]: r["cost_micro_usd"] for r in usage.call_costs(calls, usage.price_table(spark)).collect()} == {1: 1665, 2: None}
    now = dt.datetime(2026, 1, 1)
    old = now - dt.timedelta(days=91)
    p = spark.createDataFrame([("a", "completed", "r1", 3, None, old, old), ("b", "processing", "r2", 3, None, old, old), ("c", "completed", "r3", 3, None, now, now)], "project_id string, status string, run_id string, file_count int, code_removed_at timestamp, last_used_at timestamp, updated_at timestamp")
    runs = spark.createDataFrame([("r2", "running")], "run_id string, run_status string")
    facts = spark.createDataFrame([("a",), ("c",)], "project_id string")
    marked, left = lifecycle.remove_idle(p, {"files": facts}, F.lit(now))
    assert {r["project_id"] for r in marked.filter("code_removed_at IS NOT NULL").collect()} == {"a"} and [r["project_id"] for r in left["files"].collect()] == ["c"]
    assert lifecycle.stuck_projects(p, runs, F.lit(now)).count() == 0 and lifecycle.stuck_projects(p, runs.limit(0), F.lit(now)).count() == 1
    assert {r["project_id"]: r["start"] for r in lifecycle.analysis_start(p, runs, F.lit(now)).collect()} == {"a": "completed", "b": "running", "c": "completed"}
    asked = spark.createDataFrame([("b", "r9")], "project_id string, new_run_id string")
    assert lifecycle.claim(p, asked, runs.limit(0), F.lit(now)).filter("changed").first()["run_id"] == "r9"


def hits(n):
    t = dt.datetime(2026, 1, 1)
    return [("k" if i % 3 else "m", t + dt.timedelta(seconds=40 * i), 2, 100) for i in range(n)]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    schema = "key string, ts timestamp, max int, window_seconds int"
    rows = hits(30)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.rate_limit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    key = lambda df: sorted((r["key"], r["ts"], r["n"], r["allowed"]) for r in df.collect())
    assert key(spark.table("limited")) == key(jobs.rate_limit_batch(spark.createDataFrame(rows, schema)))


def test_subscriptions_converge(spark, tmp_path):
    schema = "subscription_id string, event_id string, event_time timestamp, status string"
    t = dt.datetime(2026, 1, 1)
    rows = [("s", "e2", t + dt.timedelta(hours=2), "canceled"), ("s", "e1", t, "active"), ("s", "e2", t + dt.timedelta(hours=2), "canceled")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    state = {"df": pd.DataFrame(columns=["subscription_id", "event_id", "event_time", "status"])}

    def write(df, _):
        state["rows"] = df.collect()

    q = jobs.sync_subscriptions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lambda s: s.createDataFrame(state.get("rows", []), schema), write, str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r["subscription_id"], r["status"]) for r in state["rows"]] == [("s", "canceled")]


def test_daily_counters_and_redaction_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 23)
    rows = [(1, 10, 5, t), (1, 1, 1, t + dt.timedelta(hours=2)), (2, 3, 3, t)]
    schema = "user_id int, input_tokens long, output_tokens long, created_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = jobs.daily_counters(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["user_id"], r["day"], r["tokens"], r["calls"]) for r in df.collect())
    assert key(spark.table("daily")) == key(jobs.daily_counters(spark.createDataFrame(rows, schema), None))
    line = spark.createDataFrame([('{"token":"x","m":"Bearer abc"}',)], "value string")
    assert json.loads(jobs.redact_stream(line).first()["value"]) == {"token": "[REDACTED]", "m": "Bearer [REDACTED]"}


def test_entry_and_names(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_type_declarations_go(spark):
    logic = {"interface A { f(): () => void }": False, "type B =\n  | (() => void)\n  | null;": False, "export declare type C = { g: (x: number) => void }\nconst c = 1": False, "type D = string\nexport const f = () => 1": True, "interface E { a: Array<{ b: () => void }> }\nclass F {}": True, "type G = {\n h(): Promise<() => void>": False, "const s = 'return'; // function": False}
    rows = spark.createDataFrame(list(enumerate(logic)), "i int, content string")
    got = {r["i"]: r["x"] for r in rows.select("i", graph.has_logic(F.col("content")).alias("x")).collect()}
    assert got == dict(enumerate(logic.values()))


def test_answers_that_fall_short(spark):
    said = {"The snippets do not define it.": True, "Your code doesn't reference X": True, "The code does not have a bug.": False, "The repository does not provide it": False, "There is no such thing": True, "All good": False}
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    assert {r["i"]: r["x"] for r in rows.select("i", text.abstains(F.col("t")).alias("x")).collect()} == dict(enumerate(said.values()))


def test_nearest_by_the_raw_value(spark):
    rows = [("p", 9, [1.0, 0.0]), ("p", 1, [1.0, 0.001])]
    chunks_ = spark.createDataFrame(rows, "project_id string, chunk_id int, embedding array<double>")
    query = spark.createDataFrame([("p", 0, [1.0, 0.0])], "project_id string, query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in vectors.vector_topk(query, chunks_).orderBy("rank").collect()] == [9, 1]


def test_rate_limit_over_several_batches(spark, tmp_path):
    """Hits of one key that come in frames of two rows, out of order, are decided in order of time."""
    t, schema = dt.datetime(2026, 1, 1), "key string, ts timestamp, max int, window_seconds int"
    rows = [("k", t + dt.timedelta(seconds=s), 3, 100) for s in (0, 50, 120, 10, 60, 130)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = jobs.rate_limit(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName("frames").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["n"] for r in spark.table("frames").orderBy("ts").collect()] == [1, 2, 3, 4, 1, 2]


def test_streams_of_progress_and_drafts(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(1, t, "processing"), (2, t, "processing"), (2, t + dt.timedelta(minutes=1), "failed"), (3, t + dt.timedelta(hours=5), "processing")]
    schema = "project_id long, ts timestamp, status string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(tmp_path / "p"))
    silent = jobs.detect_stuck(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p")))
    silent.writeStream.format("memory").queryName("silent").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert [r["project_id"] for r in spark.table("silent").collect()] == [1]
    spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "project_id string, content string").write.parquet(str(tmp_path / "d"))
    kept: list = []
    cache = lambda s: s.createDataFrame(kept, "project_id string, content_hash string, embedding array<float>, embedding_model string")
    for n in range(2):
        drafts = spark.readStream.schema("project_id string, content string").parquet(str(tmp_path / "d"))
        jobs.embed_stream(drafts, cache, lambda df, _: kept.extend(tuple(r) for r in df.collect()), "m", lambda texts: [[float(len(x)), 1.0] for x in texts], 2, str(tmp_path / f"e{n}")).awaitTermination()
    assert len(kept) == 2


def sanitized(value, depth=0):
    """What a log value becomes, by recursion."""
    if isinstance(value, (dict, list)) and depth > 4:
        return "[Truncated]"
    if isinstance(value, dict):
        return {k: "[REDACTED]" if re.search(text.SENSITIVE_KEY, k) else sanitized(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitized(v, depth + 1) for v in value[:20]]
    return value if not isinstance(value, str) or len(value) <= 2000 else value[:2000] + "…"


def test_nested_log_values(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.randrange(8 if depth < 7 else 5)
        if kind < 5:
            return rng.choice([None, True, 12, "plain", 'quo"te\\ \n é', "x" * 2001, "", 2.5])
        if kind == 5:
            return [made(depth + 1) for _ in range(rng.choice([0, 2, 25]) if depth < 4 else 2)]
        return {rng.choice(["a", "b", "api_key", "Cookie", "name", "k\"y"]): made(depth + 1) for _ in range(3)}

    values = [{"top": made(1), "list": made(1)} for _ in range(60)] + [[1, [2, [3, [4, [5, [6]]]]]], {}, [], "text", None, 3]
    lines = [json.dumps(v, ensure_ascii=False) for v in values]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: json.loads(r["x"]) for r in rows.select("i", text.sanitize_json(F.col("line")).alias("x")).collect()}
    assert got == {i: sanitized(v) for i, v in enumerate(values)}
    odd = spark.createDataFrame([(None,), ("{not json",), ("Bearer abcdefghijklmnop",)], "line string").select(text.sanitize_json(F.col("line")).alias("x")).collect()
    assert odd[0]["x"] is None and json.loads(odd[1]["x"]) == "{not json" and "abcdef" not in odd[2]["x"]


def test_small_chunks_of_a_long_file(spark):
    """A file of very many chunks, in batches of a few rows, takes time linear in their number; it equals a plain fold."""
    rng = random.Random(4)
    pieces = [("p", "a.ts", i, "x" * rng.choice([3, 30, 700, 900, 1599]), i, i + 1) for i in range(400)] + [("p", "b.ts", 0, "y", 1, 1), ("q", "a.ts", 0, "y", None, None)]
    want = []
    for project, path, _, content, start, end in pieces:
        last = want[-1] if want and want[-1][:2] == [project, path] else None
        if last and chunks.tokens_of(len(last[3])) < 200 and chunks.tokens_of(len(last[3]) + 2 + len(content)) <= 400:
            last[3:] = [f"{last[3]}\n\n{content}", last[4], end]
        else:
            want.append([project, path, last[2] + 1 if last else 0, content, start, end])
    schema = "project_id string, file_path string, seq int, content string, start_line int, end_line int"
    rng.shuffle(pieces)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = chunks.merge_small(spark.createDataFrame(pieces, schema)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(list, got), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    many = spark.range(100_000).select(F.lit("p").alias("project_id"), F.lit("f").alias("file_path"), F.col("id").alias("seq"), F.lit("word").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    began = time.time()
    assert chunks.merge_small(many).count() == -(-100_000 // 134) and time.time() - began < 30


def test_search_in_blocks(spark):
    """Every query against every vector of its project by brute force: ties, other lengths, no direction, keys of text, blocks of a few rows."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), f"k{i:03}", [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(300)]
    rows += [(0, "n0", None), (0, "n1", [0.0] * 5), (0, "n2", [1.0]), (0, "n3", [float("nan")] * 5), (1, None, [1.0] * 5)]
    asked = [(p, 10 * p + i, rows[50 * p + i][2]) for p in range(3) for i in range(4)] + [(0, 99, [2.0]), (1, 98, [0.0] * 5), (7, 97, [1.0] * 5), (0, 96, None)]
    frame = spark.createDataFrame(rows, "project_id int, name string, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        tops = search.blocked_topk(spark.createDataFrame(asked, "project_id int, query_id long, embedding array<double>"), frame, 8, "name", parts=3, query_parts=2)
        got = {}
        for r in tops.orderBy("rank").collect():
            got.setdefault((r["project_id"], r["query_id"]), []).append((r["name"], r["score"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for p, q, v in asked:
        scored = []
        for project, name, w in rows:
            if project == p and v and w and name and len(v) == len(w) and any(v) and any(w) and not any(math.isnan(x) for x in w):
                dot = lambda a, b: sum(x * y for x, y in zip(a, b))
                scored.append((-(dot(w, v) / math.sqrt(dot(v, v) * dot(w, w))), name))
        if scored:
            want[p, q] = [(name, -down) for down, name in sorted(scored)[:8]]
    assert got == want and len(want) == 13


def test_no_more_than_k_rows_of_a_part_leave_it(spark):
    """The exchange before the last ranking carries k rows for each query and part, not one for each pair."""
    tops = search.Tops(["a", "b"], [[1.0, 0.0], [0.0, 1.0]], 3)
    for i in range(50):
        tops.see([f"{i}-{j}" for j in range(20)], [[math.cos(i + j), math.sin(i + j)] for j in range(20)])
    assert len(list(tops.rows())) == 6


def test_reviews_keep_the_first_ten_that_hold(spark):
    """Claims without evidence do not use up the ten."""
    seen = spark.createDataFrame([("p", "a.ts", "const x = 1;\nconst y = 2;", 5, 6)], "project_id string, file_path string, content string, start_line int, end_line int")
    rows = [("p", i, "security", "high", "t" * 300, "d" * 1100, "a.ts", "const y" if i % 2 else "not there") for i in range(30)]
    claims = spark.createDataFrame(rows, "project_id string, ord int, category string, severity string, title string, description string, file_path string, quote string")
    found, dropped = review.ingest_reviews(claims, seen)
    got = found.orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(1, 21, 2)) and {(len(r["title"]), len(r["description"]), r["evidence"]["start_line"]) for r in got} == {(200, 1000, 6)}
    assert dropped.collect()[0]["dropped"] == 15


def test_prompts_of_questions(spark):
    questions = spark.createDataFrame([("p", 1), ("p", 2)], "project_id string, query_id int")
    projects = spark.createDataFrame([("p", "Shop", None, "B")], "project_id string, name string, framework string, boundary string")
    found = spark.createDataFrame([("p", 1, 2, "b.ts", None, None, 0.5, "two"), ("p", 1, 1, "a.ts", 3, 9, 0.9, "one")], "project_id string, query_id int, rank int, file_path string, start_line int, end_line int, score double, content string")
    got = {r["query_id"]: r for r in review.chat_prompts(questions, found, projects, "Role.", ["Cite.", "Data has {boundary}."]).collect()}
    head = "Role.\nProject: Shop\nDetected framework: Unknown\n\nRules:\n- Cite.\n- Data has B.\n\nRetrieved code sources:\n"
    assert got[1]["prompt"] == head + "<<<DATA B\nSource 1. File: a.ts (L3-L9)\none\nDATA B>>>\n\n<<<DATA B\nSource 2. File: b.ts (lines unknown)\ntwo\nDATA B>>>"
    assert got[2]["prompt"] == head + "(No relevant sources were retrieved.)" and got[2]["sources"] == [] and [s["score"] for s in got[1]["sources"]] == [0.9, 0.5]


@pytest.mark.parametrize("few, parts, sent", [(5, 4, 50_000), (100_000, 1024, 50_000), (3, 7, 0)])
def test_percentiles_by_ranges(spark, monkeypatch, few, parts, sent):
    """Against sorted lists: ties, one value for a third of all rows, negative and very large numbers, nulls, a group of one and a null group."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", sent)
    rng = random.Random(few)
    rows = [(rng.choice(["a", "b", None]), rng.choice([7.0, rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200)]), rng.randrange(5)) for _ in range(120)]
    rows += [("one", 3.0, None), ("none", None, None), ("ends", 1e308, 1), ("ends", -1e308, 2), ("ends", math.inf, 3), ("ends", -math.inf, 4), ("ends", 5e-324, 5), ("ends", 0.0, 6)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95}
    got = quantiles.percentiles(spark.createDataFrame(rows, "g string, x double, y int"), "g", ["x", "y"], shares)
    want = {}
    for g in {r[0] for r in rows}:
        for at, name in ((1, "x"), (2, "y")):
            held = sorted(r[at] for r in rows if r[0] == g and r[at] is not None)
            for label, share in shares.items():
                place = share * (len(held) - 1)
                under, over = math.floor(place), math.ceil(place)
                want.setdefault(g, {})[f"{name}_{label}"] = None if not held else held[under] if under == over else (over - place) * held[under] + (place - under) * held[over]
    assert {r["g"]: {k: r[k] for k in r.asDict() if k != "g"} for r in got.collect()} == want


def test_one_to_one_matching_is_the_greedy_one(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma"]
    f = [(rng.choice("cd"), i, rng.choice(["x", None]), rng.choice(["a.ts", None]), rng.choice([*words, None])) for i in range(60)]
    e = [(rng.choice("cd"), i, rng.choice(["x", None]), rng.choice(["a.ts", None]), rng.choice(["a", "alpha|beta", "^g", "m"])) for i in range(40)]
    want = set()
    left = list(e)
    for case, i, category, path, title in f:
        hit = next((x for x in left if (x[0], x[2], x[3]) == (case, category, path) and re.search(x[4], title or "")), None)
        if hit:
            left.remove(hit)
            want.add((case, i, hit[1]))
    findings_ = spark.createDataFrame(f, "case string, ord int, category string, file_path string, title string")
    expected = spark.createDataFrame(e, "case string, ord int, category string, file_path string, title_regex string")
    assert {tuple(r) for r in evals.match_expected(findings_, expected).collect()} == want and len(want) > 15
    assert evals.match_expected(findings_, expected.limit(0)).count() == 0


def test_names_that_end_inside_a_segment(spark):
    """Against all pairs of a project: slash-less and empty names on either side."""
    rng = random.Random(3)
    names = ["b", "ab", "cab", "x/ab", "y/x/ab", "x/cab", "ab/b", "bb"]
    sources = sorted({(p, rng.choice(names) + ".ts") for p in "pqr" for _ in range(9)})
    tests_ = sorted({(p, rng.choice(["", "x/", "__tests__/", "y/"]) + rng.choice(names) + ".test.ts") for p in "pq" for _ in range(4)} | {("r", ".test.ts")})
    frame = lambda rows: spark.createDataFrame(rows, "project_id string, path string")
    guess = {(r["project_id"], r["g"]) for r in frame(tests_).select("project_id", paths.guess_source(F.col("path")).alias("g")).collect()}
    bare = {(r["project_id"], r["path"]): r["b"] for r in frame(sources).select("project_id", "path", paths.strip_ext(F.col("path")).alias("b")).collect()}
    want = {k for k, b in bare.items() if any(p == k[0] and (g.endswith(b) or b.endswith(g)) for p, g in guess)}
    assert {tuple(r) for r in graph.tested_by_name(frame(sources), frame(tests_)).collect()} == want


def test_matching_writes_as_often_for_long_groups(spark, monkeypatch):
    """Sixty findings of one title, which take sixty expectations in turn, are no sixty rounds."""
    kept, calls = evals.kept, []
    monkeypatch.setattr(evals, "kept", lambda df: calls.append(1) or kept(df))
    rows = spark.range(60).selectExpr("'c' AS case", "id AS ord", "'x' AS category", "'a.ts' AS file_path", "'t' AS title", "if(id % 2 = 0, 't', '^t') AS title_regex")
    assert {(r["finding_ord"], r["expected_ord"]) for r in evals.match_expected(rows, rows).collect()} == {(i, i) for i in range(60)} and len(calls) == 1


def test_words_that_risk_signals_and_secrets_need(spark):
    """Expressions tried only where a word is found give what they give everywhere; null stays null."""
    bits = """req.body request.json( searchParams formData.get( eval( new Function( child_process execSync( exec( spawn( $where .query( .raw( .execute( $queryRawUnsafe $executeRawUnsafe .findMany( .deleteOne( innerHTML
    dangerouslySetInnerHTML document.write( redirect( fetch( axios http.get( https.request( needle got( fs.stat( readFile( readFileSync( writeFile( writeFileSync( auth( authX( NextAuth getServerSession currentUser signIn( authorize
    process.env PASSWORD passwords Session COOKIES Jwt tOkEns crypto. Math.random( xtoken eval""".split(" ")
    rows = [(i, b.strip()) for i, b in enumerate([*bits, " ".join(bits), "", "Função token É", 'API_KEY = "abcdefgh"', "ok\nPassword:\n'abcdefghi'", "akia" + "A" * 16, "AKIA" + "Q" * 16, 'jwt_secret: "x"'])] + [(999, None)]
    c = F.col("t")
    plain = sum((c.rlike(p).cast("int") for p in text.RISK_SIGNALS[1:]), c.rlike(text.RISK_SIGNALS[0]).cast("int"))
    got = spark.createDataFrame(rows, "i int, t string").select("t", text.risk_score(c).alias("a"), plain.alias("b"), text.may_hold_secret(c).alias("s"), text.secret_hint(c).isNotNull().alias("h"), text.line_count(c).alias("n"), F.size(F.split("t", "\n", -1)).alias("m")).collect()
    assert all(r["a"] == r["b"] and (r["s"] or False) == r["h"] and (r["t"] is None or r["n"] == r["m"]) for r in got) and {r["a"] for r in got} >= {0, 1, 18, None}


def test_queue_of_chunks_cuts_its_texts_once(spark):
    """What the queue is made of is written out: no branch of its plan cuts and scores texts again."""
    plan = __spark_entry__.queries()["w7_round_robin"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "password" not in plan


def test_declarations_alone_go_to_python(spark, monkeypatch):
    """Texts without a declaration of a type stay where they are; those with one lose it."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(code: pd.Series) -> pd.Series:
        seen.add(int(code.notna().sum()))
        return code.str.replace(r"(?s)interface.*", "", regex=True)

    monkeypatch.setattr(graph, "typeless", counted)
    rows = [(1, "function f() {}"), (2, "an interface of some type\ntypes of it"), (3, "x;\n  export interface A { f(): () => void }"), (4, "interface A { new X }"), (5, None)]
    got = {r["i"]: r["l"] for r in spark.createDataFrame(rows, "i int, t string").select("i", graph.has_logic(F.col("t")).alias("l")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: None} and seen.value == 2


def test_code_is_made_on_all_cores(spark, tmp_path):
    """The table is a small file that one task reads, but the code that is made of it is large."""
    spark.range(100).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = operator_queries.code_of(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 100
