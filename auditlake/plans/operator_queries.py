"""Queries for operators that the other two modules leave out: code with imports and tests, reports, shares, subscriptions, evaluation.

part stands for code files (six of a kind make a block, blocks are dealt to five projects); orders for projects, reports,
shares and candidates; customer for users; lineitem for findings, runs, answers and prompts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunks, evals, findings, graph, lifecycle, review, rules, scoring, usage, vectors
from ..sources import tables
from ..sources.tables import dealt_by, read_table
from .corpus_queries import FILES, files_of
from .registry import ORACLE_SQL, query
from .report import build_reports, project_tables
from .table_queries import CLOCK, PROJECTS, at, calls_of, projects_of, users_of

# Code: a test imports its block's lib, which imports its auth file; types hold no logic; large files and secrets by size.
CODE = """code AS (SELECT p_partkey AS n, p_partkey // 6 AS b, ((p_partkey // 6) % 5)::VARCHAR AS project_id, p_partkey % 6 AS k, p_size,
  CASE WHEN p_partkey % 6 = 0 THEN 'src/auth/f' WHEN p_partkey % 6 = 1 THEN 'src/lib/f' WHEN p_partkey % 6 = 2 THEN 'src/billing/f' WHEN p_partkey % 6 = 3 THEN 'src/ui/f' WHEN p_partkey % 6 = 5 THEN 'src/types/f' WHEN (p_partkey // 6) % 3 = 0 THEN 'src/util/f' ELSE 'tests/f' END
  || p_partkey || CASE WHEN p_partkey % 6 = 3 THEN '.tsx' WHEN p_partkey % 6 = 4 AND (p_partkey // 6) % 3 <> 0 THEN '.test.ts' ELSE '.ts' END AS path FROM part),
own AS (SELECT *, p_size * 10 + 2 + (k = 1)::INT + (k = 3 AND p_size > 45)::INT AS lines, k <> 5 AS logic FROM code WHERE path NOT LIKE 'tests/%'),
tested AS (SELECT n FROM own WHERE b % 3 <> 0 AND k IN (0, 1) AND EXISTS (SELECT 1 FROM code t WHERE t.b = own.b AND t.k = 4) AND (k = 1 OR EXISTS (SELECT 1 FROM code t WHERE t.b = own.b AND t.k = 1)))"""
PERCENT = f"{CODE}, pct AS (SELECT project_id, floor(100 * count(*) FILTER (WHERE n IN (SELECT n FROM tested)) / count(*) + 0.5)::INT AS tested_percent FROM own WHERE logic GROUP BY project_id)"


def code_of(spark, sf_dir) -> DataFrame:
    """project_id, path, content, size of the part."""
    n, block = F.col("p_partkey"), F.floor(F.col("p_partkey") / 6)
    k, name = n % 6, n.cast("string")
    is_test = (k == 4) & (block % 3 != 0)
    folder = F.when(k == 0, "src/auth/f").when(k == 1, "src/lib/f").when(k == 2, "src/billing/f").when(k == 3, "src/ui/f").when(k == 5, "src/types/f").when(is_test, "tests/f").otherwise("src/util/f")
    end = F.when(k == 3, ".tsx").when(is_test, ".test.ts").otherwise(".ts")
    imports = F.when(is_test, F.concat(F.lit('import { f } from "../src/lib/f'), (n - 3).cast("string"), F.lit('";\nimport x from "x";\n'))).when(k == 1, F.concat(F.lit('import { f } from "../auth/f'), (n - 1).cast("string"), F.lit('";\n'))).otherwise("")
    secret = F.when((k == 3) & (F.col("p_size") > 45), F.lit("const " + "token = 'abcdefgh1';\n")).otherwise("")
    body = F.when(k == 5, F.concat(F.lit("export interface A"), name, F.lit(" { f(): () => void }\n"))).otherwise(F.concat(F.lit("export function f"), name, F.lit("() { return 1; }\n")))
    content = F.concat(imports, secret, body, F.repeat(F.lit("x\n"), F.col("p_size") * 10))
    return tables.dealt(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select((block % 5).cast("string").alias("project_id"), F.concat(folder, name, end).alias("path"), content.alias("content"), F.col("p_size").alias("size"))


def sizes_of(code: DataFrame) -> DataFrame:
    """One function a file, four lines long for each unit of size."""
    return code.select("project_id", F.col("path").alias("file_path"), F.lit("f").alias("name"), (F.col("size") * 4).cast("int").alias("lines"))


@query(f"WITH {CODE} SELECT project_id, path FROM own WHERE logic")
def p7_has_logic(spark, sf_dir):
    return graph.logic_sources(code_of(spark, sf_dir))


@query(f"WITH {CODE} SELECT project_id, 'tests/f' || n || '.test' AS source, 'src/lib/f' || (n - 3) AS target, false AS facade, true AS from_test FROM code WHERE path LIKE 'tests/%' UNION ALL SELECT project_id, 'src/lib/f' || n, 'src/auth/f' || (n - 1), false, false FROM code WHERE k = 1")
def c6_import_edges(spark, sf_dir):
    return graph.import_edges(code_of(spark, sf_dir))


@query(f"WITH {PERCENT} SELECT * FROM pct")
def a4_tested_percent(spark, sf_dir):
    code = graph.kept(code_of(spark, sf_dir))
    reached = graph.reachable(graph.kept(graph.import_edges(code)))
    return graph.tested_percent(graph.logic_sources(code), graph.tested_sources(code, reached))


CRITICAL = "crit AS (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rank FROM own WHERE k IN (0, 2) QUALIFY rank <= 12)"


@query(f"WITH {CODE}, {CRITICAL} SELECT * FROM crit")
def a5_untested_critical(spark, sf_dir):
    code = graph.kept(code_of(spark, sf_dir))
    direct = graph.reachable(graph.kept(graph.import_edges(code)), facade_only=True)
    return graph.untested_critical(graph.logic_sources(code), graph.tested_sources(code, direct)).select("project_id", "path", "rank")


MEASURES = f"""{PERCENT}, m AS (SELECT project_id, count(*) AS functions, count(*) FILTER (WHERE p_size * 4 > 50) AS long, count(*) FILTER (WHERE p_size * 4 >= 80) AS complex, count(*) FILTER (WHERE lines >= 400) AS large, count(*) FILTER (WHERE k = 3 AND p_size > 45) AS hits, count(*) FILTER (WHERE k IN (0, 2)) AS critical FROM own GROUP BY project_id),
t AS (SELECT project_id, count(*) AS tests FROM code WHERE path LIKE 'tests/%' GROUP BY project_id)"""
SCORE = lambda x: f"greatest(0, least(100, floor({x} + 0.5)))::INT"


@query(f"WITH {MEASURES} SELECT project_id, long || ' of ' || functions || ' function(s) have more than 50 lines (' || complex || ' with 80+); ' || large || ' large file(s).' AS code_quality, 'Matched test files for roughly ' || tested_percent || '% of source files (' || coalesce(tests, 0) || ' test files found).' AS testing, 'Pattern scan found ' || hits || ' potential hardcoded secret hit(s).' AS security FROM m JOIN pct USING (project_id) LEFT JOIN t USING (project_id)")
def a6_summaries(spark, sf_dir):
    code = graph.kept(code_of(spark, sf_dir))
    return rules.summaries(project_tables(code, sizes_of(code))["measures"])


@query(f"""WITH {MEASURES}, s AS (SELECT project_id, 88 AS architecture, {SCORE('CASE WHEN hits > 0 THEN 70 ELSE 90 END - 40 * (1 - pow(0.5, least(10, hits)))')} AS security, 86 AS performance, {SCORE('100 - 4 * (100.0::DOUBLE * long / functions)')} AS codeQuality,
  {SCORE('CASE WHEN coalesce(tests, 0) = 0 THEN 0 ELSE 40 + 0.6::DOUBLE * tested_percent END - 24 * (1 - pow(0.5, least(8, critical))) - CASE WHEN tested_percent < 15 THEN 12 WHEN tested_percent < 40 THEN 6 ELSE 0 END')} AS testing FROM m JOIN pct USING (project_id) LEFT JOIN t USING (project_id))
SELECT project_id, architecture, security, performance, codeQuality, testing, {SCORE('(architecture + security + performance + codeQuality + testing) / 5')} AS health FROM s""")
def c15_reports(spark, sf_dir):
    """Imports, measures, all rules, groups, scores and health of every project's code."""
    code = graph.kept(code_of(spark, sf_dir))
    return build_reports(code, sizes_of(code)).select("project_id", *scoring.CATEGORIES, "health")


@query(f"WITH {CODE}, {CRITICAL} SELECT project_id, 'low-test-coverage' AS rule, 1 AS ord, NULL AS file_path, CASE WHEN tested_percent < 15 THEN 'high' ELSE 'medium' END AS severity FROM ({f'WITH {PERCENT} SELECT * FROM pct'}) WHERE tested_percent < 40 UNION ALL SELECT project_id, 'untested-critical-path', rank, path, 'high' FROM crit WHERE rank <= 8 UNION ALL SELECT project_id, 'complex-function', row_number() OVER (PARTITION BY project_id ORDER BY p_size DESC, path) AS r, path, CASE WHEN p_size * 4 >= 150 THEN 'high' ELSE 'medium' END FROM own WHERE p_size * 4 >= 80 QUALIFY r <= 12")
def a8_code_rules(spark, sf_dir):
    code = graph.kept(code_of(spark, sf_dir))
    read = project_tables(code, sizes_of(code))
    found = rules.rule_low_coverage(read["measures"]).unionByName(rules.rule_untested_critical(read["untested_critical"])).unionByName(rules.rule_complex_function(read["complex_functions"]))
    return found.select("project_id", "rule", "ord", "file_path", "severity")


# Files and their store


@query(f"WITH {FILES} SELECT project_id, path, length(content) AS size_bytes FROM files")
def s9_manifest(spark, sf_dir):
    return tables.manifest(files_of(spark, sf_dir).withColumn("size_bytes", F.length("content")))


@query(f"WITH {CODE} SELECT project_id, path FROM code")
def s10_source_files(spark, sf_dir):
    return tables.source_files(code_of(spark, sf_dir)).select("project_id", "path")


@query(f"WITH {CODE} SELECT project_id, path FROM code WHERE project_id = '0' AND path = 'src/lib/f31.ts'")
def s11_read_file(spark, sf_dir):
    return tables.read_file(code_of(spark, sf_dir), "0", "./src//lib/f31.ts").select("project_id", "path")


@query("SELECT page_id, sha256(regexp_replace(html, '[ \\t]*//[^\\n]*(?:example)[^\\n]*$', '', 'gm')) AS content FROM pages")
def s16_strip_comments(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    return tables.strip_comments(pages, "example").withColumn("content", F.sha2("content", 256))


# Projects, shares and reports


@query("WITH p AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'github' ELSE 'zip' END AS source, 'https://h/r' || o_orderkey % 50 AS url, 'a' || o_orderkey % 70 AS name, o_orderkey, o_orderstatus FROM orders) SELECT o_orderkey AS candidate FROM p c WHERE o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM p e WHERE e.o_orderkey % 3 <> 0 AND e.o_orderstatus <> 'P' AND e.user_id = c.user_id AND e.source = c.source AND CASE WHEN c.source = 'github' THEN e.url = c.url ELSE e.name = c.name END)")
def p12_existing_imports(spark, sf_dir):
    k = F.col("o_orderkey")
    p = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.when(k % 2 == 0, "github").otherwise("zip").alias("source"), F.concat(F.lit("https://h/r"), (k % 50).cast("string")).alias("source_url"), F.concat(F.lit("a"), (k % 70).cast("string")).alias("name"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"))
    return lifecycle.existing_imports(p.filter(k % 3 == 0).withColumn("source_url", F.upper("source_url")), p.filter(k % 3 != 0)).select(k.alias("candidate"))


SHARES = f"shares AS (SELECT 't' || o_orderkey AS token_hash, o_orderkey AS project_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS revoked_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS expires_at FROM orders WHERE o_orderkey % 4 <> 1), live AS (SELECT * FROM shares WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{CLOCK}'))"


def shares_of(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").filter(k % 4 != 1).select(F.concat(F.lit("t"), k.cast("string")).alias("token_hash"), k.alias("project_id"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("revoked_at"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("expires_at"))


def reports_of(spark, sf_dir) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    return o.select(F.col("o_orderkey").alias("project_id"), F.floor("o_totalprice").alias("health"), F.array_repeat(F.lit("i"), (F.col("o_orderkey") % 4).cast("int")).alias("issues"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {SHARES} SELECT token_hash, project_id, 'p' || project_id AS name, floor(o_totalprice)::BIGINT AS health FROM live JOIN orders ON o_orderkey = project_id WHERE o_orderkey % 7 <> 0")
def j4_shared_reports(spark, sf_dir):
    projects = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"))
    return lifecycle.shared_reports(shares_of(spark, sf_dir), projects, reports_of(spark, sf_dir), at(CLOCK)).select("token_hash", "project_id", "name", "health")


@query(f"WITH {PROJECTS} SELECT project_id FROM projects WHERE status = 'completed' AND project_id % 7 <> 0")
def j5_shareable(spark, sf_dir):
    return lifecycle.shareable(projects_of(spark, sf_dir)[0], reports_of(spark, sf_dir)).select("project_id")


@query("SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT END AS health, count(l_orderkey) AS chunk_count, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 ELSE 0 END AS issue_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j2_project_summary(spark, sf_dir):
    held = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return lifecycle.project_summary(projects_of(spark, sf_dir)[0], reports_of(spark, sf_dir), held).select("project_id", "health", "chunk_count", "issue_count")


@query("SELECT o_orderkey AS project_id, o_orderkey % 100 AS security, 'keep [REDACTED]' AS summary, CASE WHEN o_orderkey % 2 = 0 THEN 'budget' END AS skip_reason, 2 AS n FROM orders")
def f19_split_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.create_map(F.lit("security"), F.lit("keep " + "gh" + "p_" + "A" * 24))
    stored = F.to_json(F.struct((k % 100).alias("security"), F.lit(88).alias("architecture"), said.alias("summaries"), F.when(k % 2 == 0, "budget").alias("aiReviewSkipped")))
    out = lifecycle.split_scores(read_table(spark, sf_dir, "orders").select(k.alias("project_id"), stored.alias("category_scores")))
    return out.select("project_id", F.col("scores")["security"].alias("security"), F.col("summaries")["security"].alias("summary"), "skip_reason", F.size("scores").alias("n"))


@query("SELECT l_orderkey * 8 + l_linenumber AS ord, 'seen [REDACTED]' AS title, l_linenumber AS start_line, l_linenumber + 2 AS end_line, 'category,description,evidence,file_path,occurrences,project_id,severity,title' AS columns, 'end_line,start_line' AS lines FROM lineitem")
def f20_public_issues(spark, sf_dir):
    """`ord` stands in the description, as what is public has no other key."""
    l_ = read_table(spark, sf_dir, "lineitem")
    secret = F.lit("seen " + "AKIA" + "Q" * 16)
    evidence = F.struct(F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 2).alias("end_line"), F.lit("let private = 1").alias("snippet"))
    one = F.struct(F.lit("a.ts").alias("file_path"), F.lit("high").alias("severity"), secret.alias("title"), F.lit("d").alias("description"), F.lit("s").alias("snippet"))
    made = l_.select(F.col("l_suppkey").alias("project_id"), secret.alias("title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("description"), F.lit("high").alias("severity"), F.lit("security").alias("category"), F.lit("a.ts").alias("file_path"), evidence.alias("evidence"), F.array(one).alias("occurrences"), F.lit("x").alias("snippet"))
    shown = findings.public_issues(made)
    return shown.select(F.col("description").cast("long").alias("ord"), "title", "evidence.start_line", "evidence.end_line", F.lit(",".join(sorted(shown.columns))).alias("columns"), F.lit(",".join(sorted(f.name for f in shown.schema["evidence"].dataType))).alias("lines"))


@query("WITH i AS (SELECT l_suppkey AS user_id, 'Acct' || l_partkey % 20 AS account_login, l_orderkey * 8 + l_linenumber AS installation_id FROM lineitem), f AS (SELECT user_id, lower(account_login) AS o, min(installation_id) AS installation_id FROM i GROUP BY ALL) SELECT o_orderkey AS project_id, installation_id FROM orders LEFT JOIN f ON f.user_id = 1 + o_custkey % 10 AND f.o = 'acct' || o_orderkey % 20")
def j13_installation_for(spark, sf_dir):
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    installs = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.concat(F.lit("Acct"), (F.col("l_partkey") % 20).cast("string")).alias("account_login"), number.alias("installation_id"), number.alias("created_at"))
    projects = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), (1 + F.col("o_custkey") % 10).alias("user_id"), F.concat(F.lit("ACCT"), (F.col("o_orderkey") % 20).cast("string")).alias("owner"))
    return lifecycle.installation_for(projects, installs).select("project_id", "installation_id")


@query("WITH i AS (SELECT l_suppkey AS user_id, l_partkey * 20 + CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 20 ELSE 0 END AS installation_id FROM lineitem) SELECT * FROM i x WHERE NOT EXISTS (SELECT 1 FROM i y WHERE y.installation_id = x.installation_id AND y.user_id <> x.user_id)")
def j14_exclusive_some(spark, sf_dir):
    """Of even parts each supplier has an installation of its own, unless two fall together."""
    number = F.col("l_partkey") * 20 + F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 20).otherwise(0)
    return lifecycle.exclusive_installs(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), number.alias("installation_id")))


@query("WITH f AS (SELECT p_partkey % 5 AS project_id, p_partkey AS n FROM part) SELECT DISTINCT project_id::VARCHAR AS project_id, 'src/a' || n || '.ts' AS path FROM f WHERE n % 2 = 0")
def j11_named_tests(spark, sf_dir):
    """Every even file has a test of its name beside it, in a folder of tests."""
    n = F.col("p_partkey")
    p = read_table(spark, sf_dir, "part").select((n % 5).cast("string").alias("project_id"), n.cast("string").alias("n"))
    sources = p.select("project_id", F.concat(F.lit("src/a"), "n", F.lit(".ts")).alias("path"))
    return graph.tested_by_name(sources, p.filter(F.col("n").cast("int") % 2 == 0).select("project_id", F.concat(F.lit("src/__tests__/a"), "n", F.lit(".test.ts")).alias("path")))


@query(f"WITH {PROJECTS} SELECT project_id, CASE WHEN project_id % 9 = 0 AND status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN project_id % 9 = 0 AND status = 'processing' THEN CASE WHEN file_count > 0 THEN 'The analysis stopped before finishing. Please try again.' ELSE 'The import did not finish. Please create the project again.' END END AS error FROM projects")
def m9_fail_stuck(spark, sf_dir):
    projects = projects_of(spark, sf_dir)[0]
    return lifecycle.fail_stuck(projects, projects.filter("project_id % 9 = 0 AND status = 'processing'"), at(CLOCK)).select("project_id", "status", "error")


@query(f"WITH {SHARES} SELECT token_hash, CASE WHEN project_id % 2 = 0 AND revoked_at IS NULL THEN TIMESTAMP '{CLOCK}' ELSE revoked_at END AS revoked_at FROM shares")
def m10_revoke(spark, sf_dir):
    shares = shares_of(spark, sf_dir)
    return lifecycle.revoke(shares, shares.filter("project_id % 2 = 0"), "token_hash", at(CLOCK)).select("token_hash", "revoked_at")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'free' ELSE 'premium' END AS plan, CASE WHEN c_custkey % 3 = 0 THEN 'canceled' ELSE 'active' END AS plan_status, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS subscription_id, CASE WHEN c_custkey % 3 <> 0 THEN 'x' END AS price_id FROM customer")
def m10_cancel_subscriptions(spark, sf_dir):
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("premium").alias("plan"), F.lit("active").alias("plan_status"), F.col("c_name").alias("subscription_id"), F.lit("x").alias("price_id"))
    return lifecycle.cancel_subscriptions(users, users.filter("user_id % 3 = 0"))


@query("SELECT event_id FROM events WHERE event_id % 6 <> 0")
def m10_refund(spark, sf_dir):
    usage_ = read_table(spark, sf_dir, "events").select("event_id")
    return lifecycle.refund(usage_, usage_.filter("event_id % 6 = 0"))


@query("SELECT c_custkey AS user_id, NULL::VARCHAR AS token FROM customer")
def m11_clear_column(spark, sf_dir):
    return lifecycle.clear_column(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("token")), "token")


# Subscriptions and calls

SUBS = "subs AS (SELECT o_orderkey AS subscription_id, o_custkey AS customer_id, CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'unpaid' WHEN 3 THEN 'paused' WHEN 4 THEN 'past_due' ELSE 'strange' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE 'pro' END AS price_id, o_orderdate AS created_at FROM orders)"


def subs_of(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "trialing", "unpaid", "paused", "past_due", "strange")]), (k % 6 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select(k.alias("subscription_id"), F.col("o_custkey").alias("customer_id"), status.alias("status"), F.when(k % 4 == 0, "other").otherwise("pro").alias("price_id"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {SUBS} SELECT subscription_id, CASE WHEN status IN ('active', 'trialing') THEN 'active' WHEN status IN ('unpaid', 'past_due') THEN 'past_due' WHEN status = 'paused' THEN 'canceled' ELSE 'none' END AS plan_status, CASE WHEN price_id = 'pro' AND status IN ('active', 'trialing', 'unpaid', 'past_due') THEN 'premium' ELSE 'free' END AS plan FROM subs")
def p14_entitlements(spark, sf_dir):
    return usage.entitlements(subs_of(spark, sf_dir), "pro").select("subscription_id", "plan_status", "plan")


@query(f"WITH {SUBS} SELECT customer_id, subscription_id FROM subs QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY status IN ('active', 'trialing', 'past_due') DESC, created_at DESC, subscription_id DESC) = 1")
def w13_current_subscription(spark, sf_dir):
    return usage.current_subscription(subs_of(spark, sf_dir)).select("customer_id", "subscription_id")


@query("SELECT o_orderkey AS subscription_id, coalesce((SELECT c_custkey FROM customer WHERE c_custkey = CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN -1 END), (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey = o_custkey)) AS user_id FROM orders")
def j17_subscription_users(spark, sf_dir):
    k = F.col("o_orderkey")
    subs = read_table(spark, sf_dir, "orders").select(k.alias("subscription_id"), F.when(k % 3 == 0, F.col("o_custkey")).when(k % 3 == 1, F.lit(-1)).alias("meta_user_id"), F.col("o_custkey").alias("customer_id"))
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("customer_id"))
    return usage.subscription_users(subs, users).select("subscription_id", "user_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN 'fatal' ELSE CASE WHEN event_id % 5 >= 3 THEN 'given_up' ELSE 'retry' END END AS verdict FROM events")
def p20_classify_failures(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("cancelled", "user_error", "timeout", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return lifecycle.classify_failures(read_table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_id") % 5).alias("attempt"))).select("event_id", "verdict")


@query("SELECT event_id, event_id % 4 IN (0, 1) AS rate_limited, event_id % 4 = 1 AS quota_spent, 'HTTP 429 org_***' AS error FROM events")
def p22_classify_calls(spark, sf_dir):
    body = F.element_at(F.array(*[F.lit(s) for s in ("Rate limit reached", "rate limit reached for tokens per day", "Rate limit reached: Request too large", "no")]), (F.col("event_id") % 4 + 1).cast("int"))
    return evals.classify_calls(read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("HTTP 429 org_a"), F.col("event_id").cast("string")).alias("error"), body.alias("body"))).select("event_id", "rate_limited", "quota_spent", "error")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'reuse' WHEN event_id % 2 = 0 THEN 'disabled' WHEN event_id % 3 = 0 THEN 'budget' WHEN event_id % 7 = 0 THEN 'unavailable' ELSE 'review' END AS outcome FROM events")
def p16_review_outcome(spark, sf_dir):
    e = F.col("event_id")
    made = read_table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, "h").alias("stored_hash"), F.lit("h").alias("input_hash"), (e % 2 != 0).alias("enabled"), (e % 3 != 0).alias("budget_left"), (e % 7 != 0).alias("available"))
    return review.review_outcome(made).select("event_id", "outcome")


@query("SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 9 = 0 THEN 'neutral' WHEN o_orderkey % 101 >= 75 THEN 'good' WHEN o_orderkey % 101 >= 50 THEN 'ok' ELSE 'poor' END AS tone FROM orders")
def p17_score_tone(spark, sf_dir):
    k = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(k.alias("project_id"), text.score_tone(F.when(k % 9 != 0, k % 101)).alias("tone"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'own/repo' || page_id WHEN 1 THEN 'team/r.' || page_id END AS full_name FROM pages")
def p21_repo_full_name(spark, sf_dir):
    n = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("own/repo"), n)).otherwise("my project")
    url = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://github.com/team/r."), n, F.lit(".git"))).otherwise("https://example.org/a/b")
    return read_table(spark, sf_dir, "pages").select("page_id", paths.repo_full_name(name, url).alias("full_name"))


@query(f"WITH {PROJECTS}, c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT project_id, coalesce(n, 0) AS chunks, (project_id % 100)::DOUBLE AS seconds, (project_id % 100)::DOUBLE / n AS seconds_a_chunk FROM projects LEFT JOIN c ON l_orderkey = project_id")
def a36_analysis_durations(spark, sf_dir):
    projects = projects_of(spark, sf_dir)[0]
    done = projects.select("project_id", (F.col("created_at") + F.make_interval(secs=F.col("project_id") % 100)).alias("created_at"))
    held = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return lifecycle.analysis_durations(projects, done, held).select("project_id", "chunks", "seconds", "seconds_a_chunk")


@query(f"WITH {PROJECTS} SELECT project_id FROM projects ORDER BY project_id DESC LIMIT 50")
def o3_in_order(spark, sf_dir):
    """The last fifty: the limit is the operator's."""
    return lifecycle.in_order(projects_of(spark, sf_dir)[0], "project_id", 50).select("project_id")


# Reviews, answers and their evaluation


@query("SELECT DISTINCT l_suppkey AS project_id, 'f' || l_partkey AS file_path FROM lineitem")
def u3_sample_files(spark, sf_dir):
    return review.sample_files(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path")))


@query("SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey END AS review FROM orders")
def j18_reuse_reviews(spark, sf_dir):
    k = F.col("o_orderkey")
    inputs = read_table(spark, sf_dir, "orders").select(k.alias("project_id"), F.sha2(k.cast("string"), 256).alias("input_hash"))
    stored = read_table(spark, sf_dir, "orders").select(k.alias("project_id"), F.sha2(F.when(k % 2 == 0, k).otherwise(-k).cast("string"), 256).alias("input_hash"), F.concat(F.lit("r"), k.cast("string")).alias("review"))
    return review.reuse_reviews(inputs, stored).select("project_id", "review")


@query("WITH s AS (SELECT l_suppkey AS c, l_partkey AS f, l_linenumber * 10 AS a, l_linenumber * 10 + 4 AS b FROM lineitem), x AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS f, l_quantity::INT AS line FROM lineitem) SELECT c AS \"case\", 'f' || f AS file_path, line, EXISTS (SELECT 1 FROM s WHERE s.c = x.c AND s.f = x.f AND line BETWEEN a AND b) AS in_sample FROM x")
def j12_lines_in_sample(spark, sf_dir):
    l_ = read_table(spark, sf_dir, "lineitem").withColumns({"case": F.col("l_suppkey"), "file_path": F.concat(F.lit("f"), F.col("l_partkey").cast("string"))})
    expected = l_.select("case", "file_path", F.col("l_quantity").cast("int").alias("line")).distinct()
    return evals.lines_in_sample(expected, l_.select("case", "file_path", (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + 4).alias("end_line")))


@query("SELECT l_orderkey * 8 + l_linenumber AS ord, CASE l_linenumber WHEN 1 THEN 'any' ELSE 'one' END AS rule_id FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_partkey % 2 = 0)")
def j21_forbidden_hits(spark, sf_dir):
    l_ = read_table(spark, sf_dir, "lineitem")
    found = l_.select(F.lit("c").alias("case"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("Rule "), F.col("l_linenumber").cast("string"), F.lit(".")).alias("title"), F.when(F.col("l_partkey") % 2 == 0, "a.ts").otherwise("b.ts").alias("file_path"))
    banned = l_.sparkSession.createDataFrame([("c", r"Rule 1\.", None, "any"), ("c", r"^Rule [2]\.$", "a.ts", "one"), ("d", ".", None, "no")], "case string, title_regex string, file_path string, rule_id string")
    return evals.forbidden_hits(found, banned).select("ord", "rule_id")


@query("SELECT o_orderkey AS name, CASE o_orderkey % 6 WHEN 0 THEN 'not locked' WHEN 1 THEN 'unknown prompt' WHEN 2 THEN 'version changed' WHEN 3 THEN 'not measured' WHEN 4 THEN 'measured by another version' ELSE 'ok' END AS status FROM orders")
def j22_prompt_lock_status(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    k = F.col("name") % 6
    lock = o.filter(k != 0).select("name", F.when(k == 2, "old").otherwise("new").alias("locked_version"), F.concat(F.lit("r"), F.col("name").cast("string")).alias("result"))
    results = o.filter(k != 3).select(F.concat(F.lit("r"), F.col("name").cast("string")).alias("result"), F.when(k == 4, "old").otherwise("new").alias("measured_version"))
    return evals.prompt_lock_status(o.filter(k != 1).select("name", F.lit("new").alias("version")), lock, results)


CITED = "cited AS (SELECT l_suppkey AS repo, l_orderkey AS question, CASE l_linenumber % 3 WHEN 0 THEN 'src/f' || l_partkey || '.ts' WHEN 1 THEN 'f' || l_partkey || '.ts' ELSE 'none.ts' END AS \"as\", l_partkey % 2 = 0 AS got, l_linenumber % 3 <> 2 AS known FROM lineitem)"


def cited_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    l_ = read_table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    k = F.col("l_linenumber") % 3
    named = F.when(k == 0, path).when(k == 1, paths.basename(path)).otherwise("none.ts")
    cited = l_.select(F.col("l_suppkey").alias("repo"), F.col("l_orderkey").alias("question"), named.alias("as"))
    return cited, l_.filter("l_partkey % 2 = 0").select(F.col("l_suppkey").alias("repo"), F.col("l_orderkey").alias("question"), path.alias("path")), l_.select(F.col("l_suppkey").alias("repo"), path.alias("path"))


@query(f"WITH {CITED} SELECT repo, question, \"as\", CASE WHEN NOT known THEN 'unknown' WHEN got THEN 'retrieved' ELSE 'unseen' END AS kind FROM cited")
def j19_classify_citations(spark, sf_dir):
    return evals.classify_citations(*cited_of(spark, sf_dir)).select("repo", "question", "as", "kind")


@query(f"WITH {CITED}, g AS (SELECT repo, question, count(*) FILTER (WHERE known AND got) AS good, count(*) FILTER (WHERE known) AS own FROM cited GROUP BY ALL), a AS (SELECT DISTINCT l_suppkey AS repo, l_orderkey AS question FROM lineitem) SELECT repo, count(*) AS answered, avg(CASE WHEN own = 0 THEN 1 ELSE good / own END) AS citation_validity, avg((question % 4 = 1)::INT) FILTER (WHERE question % 3 = 0) AS abstains FROM a JOIN g USING (repo, question) GROUP BY repo")
def a31_grounding_metrics(spark, sf_dir):
    cited, retrieved, known = cited_of(spark, sf_dir)
    rows = 2 * (cited.count() + retrieved.count() + known.count())
    answers = dealt_by(cited.select("repo", "question"), rows, "repo", "question").distinct()
    q = F.col("question")
    said = F.element_at(F.array(*[F.lit(s) for s in ("The code does have a bug.", "The sources don’t define it.", "All is well.", "The snippets do not have a bug.")]), (q % 4 + 1).cast("int"))
    made = answers.withColumns({"answerable": q % 3 != 0, "answer": said, "expected": F.array().cast("array<string>")})
    return evals.grounding_metrics(made, evals.classify_citations(cited, retrieved, known, rows), rows).select("repo", "answered", "citation_validity", "abstains")


@query("WITH r AS (SELECT l_suppkey AS c, l_linenumber <> 1 AS ok, l_linenumber AS f, 7 AS w, l_linenumber - 1 AS k, l_quantity AS ms FROM lineitem) SELECT c AS \"case\", count(*) FILTER (WHERE ok) AS runs, avg(f / w) FILTER (WHERE ok) AS mean_recall, min(f / w) FILTER (WHERE ok) AS min_recall, avg(CASE WHEN k = 0 THEN 1 ELSE k / f END) FILTER (WHERE ok) AS evidence_validity, avg(ms) FILTER (WHERE ok) AS mean_latency_ms, bool_and(NOT ok) AS not_measured FROM r GROUP BY c")
def a29_review_metrics(spark, sf_dir):
    n = F.col("l_linenumber")
    runs = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case"), (n != 1).alias("ok"), F.lit(True).alias("rate_limited"), n.alias("found"), F.lit(7).alias("wanted"), (n - 1).alias("kept"), n.alias("claimed"), F.lit(1).alias("in_sample"), F.col("l_quantity").alias("latency_ms"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    return evals.review_metrics(runs).select("case", "runs", "mean_recall", "min_recall", "evidence_validity", "mean_latency_ms", "not_measured")


@query("SELECT o_custkey AS repo, o_orderkey AS \"case\", coalesce(o_orderkey % 100 < lag(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), true) AS falls FROM orders")
def w15_ranking_monotonic(spark, sf_dir):
    scores = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("case"), F.col("o_totalprice").alias("share"), (F.col("o_orderkey") % 100).alias("score"))
    return evals.ranking_monotonic(scores).select("repo", "case", "falls")


@query("SELECT o_custkey AS repo, o_orderkey AS \"commit\", o_orderkey % 100 - lag(o_orderkey % 100) OVER w AS change, first(o_orderkey % 100) OVER w AS first_score, last(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w17_score_trend(spark, sf_dir):
    results = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("commit"), (F.col("o_orderkey") % 100).alias("score"), F.lit(1).alias("score_v1"))
    return evals.score_trend(results).select("repo", "commit", "change", "first_score", "last_score")


@query("SELECT conv_id, turn, regexp_matches(replace(text, '’', ''''), '(?i)insufficient|there is no|not enough (?:information|context)|no (?:relevant )?(?:code|sources?|snippets?|mention|reference)') AS abstains FROM conversations".replace("text, '’'", "coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' There is no such file.' WHEN 1 THEN ' It has one.' ELSE ' not enough context' END, '’'"))
def f13_abstains(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    end = F.when(F.col("turn") % 3 == 0, " There is no such file.").when(F.col("turn") % 3 == 1, " It has one.").otherwise(" not enough context")
    return c.select("conv_id", "turn", text.abstains(F.concat(F.coalesce("text", F.lit("")), end)).alias("abstains"))


@query(f"WITH {FILES} SELECT project_id, path, CASE WHEN length(content) > 12000 THEN 12000 + {len(text.EXPLAIN_MARK)} ELSE length(content) END AS chars FROM files")
def p19_explain_cut(spark, sf_dir):
    return files_of(spark, sf_dir).select("project_id", "path", F.length(text.explain_cut(F.col("content"))).alias("chars"))


@query("SELECT l_suppkey AS project_id, 'src/C' || l_partkey || '.tsx' AS file_path, CASE WHEN l_linenumber % 2 = 0 THEN 'Card' ELSE 'anonymous' END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 10 END AS lines FROM lineitem")
def c5_function_sizes(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    spans = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.concat(F.lit("src/C"), F.col("l_partkey").cast("string"), F.lit(".tsx")).alias("file_path"), F.when(even, "Card").alias("name"), F.lit(1).alias("start_line"), F.lit(10).alias("end_line"), F.lit(5).alias("logic_end_line"))
    return chunks.function_sizes(spans)


@query(f"WITH {FILES}, d AS (SELECT project_id, content, length(content) % 3 = 0 AS stored FROM files) SELECT project_id, count(DISTINCT content) AS reused FROM d WHERE stored GROUP BY project_id")
def u4_reused_count(spark, sf_dir):
    drafts = files_of(spark, sf_dir).select("project_id", "content")
    known = drafts.filter(F.length("content") % 3 == 0).select("project_id", text.content_hash(F.col("content")).alias("content_hash")).distinct()
    return vectors.reused_count(drafts, known)


@query("SELECT label AS project_id, count(*) AS chunks, count(*) FILTER (WHERE vec_id % 3 = 0) AS marked FROM embeddings WHERE label % 2 = 0 GROUP BY label UNION ALL SELECT label, count(*), NULL FROM embeddings WHERE label % 2 <> 0 GROUP BY label")
def c11_store_knowledge(spark, sf_dir):
    """Projects of an even number get new chunks of the same contents, whose vectors are reused where the old ones had one."""
    e = read_table(spark, sf_dir, "embeddings")
    content = F.col("vec_id").cast("string")
    cols = [F.col("label").alias("project_id"), content.alias("content"), text.content_hash(content).alias("content_hash")]
    state = e.select(*cols, F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(2.0)).cast("array<float>")).alias("embedding"), F.lit("m").alias("embedding_model"))
    drafts = state.filter("project_id % 2 = 0").select("project_id", "content")
    fresh = drafts.select("project_id", text.content_hash(F.col("content")).alias("content_hash"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    out, _ = vectors.store_knowledge(state, drafts, state.limit(0).drop("content"), "m", fresh)
    marked = F.when(F.first(F.col("project_id") % 2 == 0), F.count_if(F.col("embedding")[0] == 2.0))
    return out.groupBy("project_id").agg(F.count("*").alias("chunks"), marked.alias("marked"))


# SQL of queries on chunks and texts. No document's path is a test's, or has a word of server logic.

RISK_SQL = " + ".join("regexp_matches(content, '" + p.replace("'", "''") + "')::INT" for p in text.RISK_SIGNALS)
SAMPLE_SQL = rf"""WITH RECURSIVE {FILES}, p AS (SELECT project_id, path AS file_path, content AS whole, unnest(range(0, greatest(1, ceil((length(content) - 200) / 1400))::INT)) AS seq FROM files WHERE length(content) > 0),
c AS (SELECT project_id, file_path, seq, rtrim(whole[seq * 1400 + 1:seq * 1400 + 1600], ' ' || chr(9) || chr(10) || chr(13)) AS content, 1 + length(whole[1:seq * 1400]) - length(replace(whole[1:seq * 1400], chr(10), '')) AS start_line FROM p),
k AS (SELECT *, {RISK_SQL} AS risk, least(length(content), 2500) + CASE WHEN length(content) > 2500 THEN {len(text.CUT_MARK) + 1} ELSE 0 END + length(file_path) + 150 AS chars FROM c WHERE content <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY risk DESC, start_line, seq) AS turn FROM k),
f AS (SELECT project_id, file_path, CASE WHEN risk > 0 THEN 1 ELSE 5 END AS level, risk, split_part(file_path, '/', 1) AS dir, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN risk > 0 THEN 1 ELSE 5 END, risk DESC, file_path) AS file_rank FROM r WHERE turn = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY project_id, level, dir ORDER BY file_rank) AS dir_turn, min(file_rank) OVER (PARTITION BY project_id, level, dir) AS dir_first FROM f),
h AS (SELECT project_id, file_path, row_number() OVER (PARTITION BY project_id ORDER BY level, dir_turn, dir_first) AS place FROM g),
q AS (SELECT r.*, (row_number() OVER (PARTITION BY project_id ORDER BY turn, place))::INT AS queue FROM r JOIN h USING (project_id, file_path)),
b AS (SELECT DISTINCT project_id, 0 AS queue, 0 AS used, 0 AS n, false AS taken FROM q UNION ALL SELECT q.project_id, q.queue, CASE WHEN b.n < 24 AND b.used + chars <= 19000 THEN b.used + chars ELSE b.used END, b.n + (b.n < 24 AND b.used + chars <= 19000)::INT, b.n < 24 AND b.used + chars <= 19000 FROM b JOIN q ON q.project_id = b.project_id AND q.queue = b.queue + 1),
s AS (SELECT q.* FROM q JOIN b USING (project_id, queue) WHERE b.taken)"""
ORACLE_SQL["w7_round_robin"] = SAMPLE_SQL.split(",\nb AS (")[0] + " SELECT project_id, file_path, seq, queue FROM q"
ORACLE_SQL["w9_review_sample"] = f"{SAMPLE_SQL} SELECT project_id, file_path, seq, chars FROM s"
ORACLE_SQL["a35_sample_stats"] = f"{SAMPLE_SQL} SELECT project_id, count(*) AS chunks, sum(least(length(content), 2500)) AS chars, count(DISTINCT file_path) AS files, count(DISTINCT split_part(file_path, '/', 1)) AS directories, 0 AS tests, ceil(sum(least(length(content), 2500)) / 4) AS tokens FROM s GROUP BY project_id"
ORACLE_SQL["f4_prompt_version"] = "SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN lower(printf('%08x', list_reduce(list_concat([2166136261::BIGINT], list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) END AS version FROM conversations"


def redact_sql(pairs: list[tuple[str, str]]) -> str:
    """Nested replacements, with an alternative for each quotation mark in place of the reference back to it."""
    quoted = "(?:" + "|".join(f"({q})[^\"'`\\n]{{4,}}{q}" for q in "\"'`") + ")"
    sql = "text"
    for pattern, put in pairs:
        pattern = pattern.replace("([\"'`])[^\"'`\\n]{4,}\\3", quoted)
        put = put.replace("$3", "\\3\\4\\5").replace("$", "\\")
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return sql


ORACLE_SQL["f10_redact_public"] = f"SELECT doc_id, sha256(redacted) AS redacted, redacted <> text AS changed FROM (SELECT doc_id, text, {redact_sql(text.LOG_SECRETS + text.PUBLIC_SECRETS)} AS redacted FROM documents)"
ORACLE_SQL["t7_redact"] = f"""WITH r AS (SELECT doc_id, {redact_sql(text.LOG_SECRETS)} AS t FROM documents), m AS (SELECT doc_id, CASE WHEN length(t) > 2000 THEN t[1:2000] || '…' ELSE t END AS t FROM r)
SELECT doc_id::VARCHAR AS id, '[REDACTED]' AS api_key, length('{{"id":"' || doc_id || '",' || coalesce('"message":' || to_json(t) || ',', '') || '"api_key":"[REDACTED]"}}') AS chars FROM m"""
