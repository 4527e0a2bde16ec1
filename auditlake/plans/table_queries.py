"""Queries on accounts, projects and events: usage, quotas, lifecycle, mutations, streams' batch forms.

customer stands for users, orders for projects, lineitem for findings, events for usage and model calls; reference
times are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evals, findings, lifecycle, rules, usage
from ..sources.tables import dealt_by, read_table
from ..streaming import jobs
from .registry import query

DAY, CLOCK = "2024-01-15 00:00:00", "2001-08-01 00:00:00"
USERS = "users AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'premium' ELSE 'free' END AS plan, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' WHEN 2 THEN 'canceled' ELSE 'none' END AS plan_status FROM customer)"
PLANS = "plans(plan, max_projects, analyses_per_day, tokens_per_day, chat_per_hour) AS (VALUES ('free', 5, 5, 200000, 20), ('premium', NULL, 50, 2000000, 200))"
CALLS = "calls AS (SELECT event_id, user_id, event_type AS feature, CASE event_id % 3 WHEN 0 THEN 'openai/gpt-oss-120b' WHEN 1 THEN 'openai/gpt-oss-20b' ELSE 'other' END AS model, floor(value * 100)::BIGINT AS input_tokens, floor(value * 10)::BIGINT AS output_tokens, floor(value * 7)::BIGINT AS latency_ms, event_id % 10 <> 0 AS ok, ts AS created_at FROM events)"
COST = "floor(input_tokens * CASE model WHEN 'openai/gpt-oss-120b' THEN 0.15::DOUBLE WHEN 'openai/gpt-oss-20b' THEN 0.075::DOUBLE END + output_tokens * CASE model WHEN 'openai/gpt-oss-120b' THEN 0.6::DOUBLE WHEN 'openai/gpt-oss-20b' THEN 0.3::DOUBLE END + 0.5)::BIGINT"
PROJECTS = f"projects AS (SELECT o_orderkey AS project_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'completed' END END AS status, (o_orderkey % 5)::INT AS file_count, 'run' || o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS code_removed_at, o_orderdate AS created_at, o_orderdate AS updated_at, o_orderdate AS last_used_at FROM orders), runs AS (SELECT 'run' || o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS run_status FROM orders WHERE o_orderkey % 2 = 0)"
CLAIM = "(code_removed_at IS NULL AND (status = 'queued' OR (status = 'failed' AND file_count > 0) OR (status = 'processing' AND CASE WHEN run_status IS NOT NULL THEN run_status NOT IN ('pending', 'running') ELSE updated_at < TIMESTAMP '2001-08-01' - INTERVAL 360 SECOND END)))"


def at(stamp: str) -> Column:
    return F.lit(stamp).cast("timestamp_ntz")


def users_of(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "past_due", "canceled", "none")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "premium").otherwise("free").alias("plan"), status.alias("plan_status"))


def calls_of(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    model = F.element_at(F.array(*[F.lit(m) for m in ("openai/gpt-oss-120b", "openai/gpt-oss-20b", "other")]), (F.col("event_id") % 3 + 1).cast("int"))
    tokens = lambda k: F.floor(F.col("value") * k)
    return e.select("event_id", "user_id", F.col("event_type").alias("feature"), model.alias("model"), tokens(100).alias("input_tokens"), tokens(10).alias("output_tokens"), tokens(7).alias("latency_ms"), (F.col("event_id") % 10 != 0).alias("ok"), F.col("ts").alias("created_at"))


def projects_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").when(k % 3 == 0, "queued").when(k % 3 == 1, "failed").otherwise("completed")
    run = F.concat(F.lit("run"), k.cast("string"))
    projects = o.select(k.alias("project_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), (k % 5).cast("int").alias("file_count"), run.alias("run_id"), F.when(k % 11 == 0, F.col("o_orderdate")).alias("code_removed_at"), *[F.col("o_orderdate").alias(c) for c in ("created_at", "updated_at", "last_used_at")])
    runs = o.filter(k % 2 == 0).select(run.alias("run_id"), F.when(k % 4 == 0, "running").when(k % 4 == 1, "completed").otherwise("failed").alias("run_status"))
    return projects, runs


@query(f"WITH {USERS}, {PLANS} SELECT user_id, CASE WHEN u.plan = 'premium' AND plan_status IN ('active', 'past_due') THEN 'premium' ELSE 'free' END AS effective_plan, max_projects, tokens_per_day FROM users u JOIN plans p ON p.plan = CASE WHEN u.plan = 'premium' AND plan_status IN ('active', 'past_due') THEN 'premium' ELSE 'free' END")
def p13_with_limits(spark, sf_dir):
    return usage.with_limits(users_of(spark, sf_dir), usage.plan_table(spark)).select("user_id", "effective_plan", "max_projects", "tokens_per_day")


SNAPSHOT_SQL = f"""{USERS}, {PLANS}, {CALLS}, a AS (SELECT user_id, count(*) AS analyses FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{DAY}' AND event_id % 5 <> 0 GROUP BY user_id), t AS (SELECT user_id, sum(input_tokens + output_tokens) AS tokens FROM calls WHERE created_at >= TIMESTAMP '{DAY}' GROUP BY user_id), p AS (SELECT o_custkey AS user_id, count(*) AS projects FROM orders GROUP BY o_custkey),
snap AS (SELECT u.user_id, l.plan AS effective_plan, max_projects, analyses_per_day, tokens_per_day, coalesce(projects, 0) AS projects, coalesce(analyses, 0) AS analyses, coalesce(tokens, 0) AS tokens FROM users u JOIN plans l ON l.plan = CASE WHEN u.plan = 'premium' AND plan_status IN ('active', 'past_due') THEN 'premium' ELSE 'free' END LEFT JOIN p USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN t USING (user_id))"""


def snapshot_of(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("type"), F.col("ts").alias("created_at"))
    analyses = usage.analyses_since(e, e.filter("event_id % 5 = 0").select("event_id"), at(DAY), "view")
    projects = usage.project_counts(projects_of(spark, sf_dir)[0])
    return usage.billing_snapshot(users_of(spark, sf_dir), usage.plan_table(spark), projects, analyses, usage.tokens_since(calls_of(spark, sf_dir), at(DAY)))


@query(f"WITH {SNAPSHOT_SQL} SELECT user_id, effective_plan, projects, analyses, tokens FROM snap")
def a26_billing_snapshot(spark, sf_dir):
    return snapshot_of(spark, sf_dir).select("user_id", "effective_plan", "projects", "analyses", "tokens")


@query(f"WITH {SNAPSHOT_SQL} SELECT user_id, effective_plan, coalesce(projects < max_projects, true) AS may_add_project, coalesce(analyses < analyses_per_day, true) AS may_analyse, coalesce(tokens < tokens_per_day, true) AS may_call, effective_plan = 'free' AS can_upgrade FROM snap")
def a22_quota_verdicts(spark, sf_dir):
    return usage.quota_verdicts(snapshot_of(spark, sf_dir))


@query("SELECT o_custkey AS user_id, count(*) AS projects FROM orders GROUP BY o_custkey")
def a20_project_counts(spark, sf_dir):
    return usage.project_counts(projects_of(spark, sf_dir)[0])


@query(f"WITH {CALLS} SELECT user_id, sum(input_tokens + output_tokens) AS tokens FROM calls WHERE created_at >= TIMESTAMP '{DAY}' GROUP BY user_id")
def a23_tokens_today(spark, sf_dir):
    return usage.tokens_since(calls_of(spark, sf_dir), at(DAY))


@query(f"WITH {CALLS} SELECT event_id, {COST} AS cost_micro_usd FROM calls")
def a24_call_costs(spark, sf_dir):
    return usage.call_costs(calls_of(spark, sf_dir), usage.price_table(spark)).select("event_id", "cost_micro_usd")


@query(f"WITH {CALLS}, k AS (SELECT *, {COST} AS cost FROM calls) SELECT feature, count(*) AS n, {', '.join(f'quantile_cont({v}, {p}) AS {v}_{n}' for v in ('input_tokens', 'output_tokens', 'latency_ms') for p, n in ((0.5, 'p50'), (0.95, 'p95')))}, avg((NOT ok)::INT) AS failed_share, sum(cost) AS total_cost FROM k GROUP BY feature")
def a25_usage_profile(spark, sf_dir):
    return usage.usage_profile(usage.call_costs(calls_of(spark, sf_dir), usage.price_table(spark)))


@query("SELECT event_type AS stage, count(*) AS n, quantile_cont(value, 0.5) AS seconds_p50, quantile_cont(value, 0.95) AS seconds_p95 FROM events GROUP BY event_type")
def a37_stage_latency(spark, sf_dir):
    return usage.stage_latency(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query(f"WITH {CALLS} SELECT event_id, feature <> 'error' AS enabled FROM calls")
def j16_with_switch(spark, sf_dir):
    switches = spark.createDataFrame([("error", False), ("view", True)], "feature string, enabled boolean")
    return usage.with_switch(calls_of(spark, sf_dir), switches).select("event_id", "enabled")


@query(f"WITH {CALLS} SELECT event_id, {COST} AS cost_micro_usd, feature <> 'error' AS enabled FROM calls")
def t3_enrich_calls(spark, sf_dir):
    switches = spark.createDataFrame([("error", False)], "feature string, enabled boolean")
    return jobs.enrich_calls(calls_of(spark, sf_dir), usage.price_table(spark), switches).select("event_id", "cost_micro_usd", "enabled")


@query(f"WITH {CALLS} SELECT user_id, date_trunc('day', created_at) AS day, sum(input_tokens + output_tokens) AS tokens, count(*) AS calls FROM calls GROUP BY ALL")
def t2_daily_counters(spark, sf_dir):
    return jobs.daily_counters(calls_of(spark, sf_dir), None)


@query("WITH RECURSIVE h AS (SELECT user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), s AS (SELECT key, ts, i, ts AS opened, 1 AS n FROM h WHERE i = 1 UNION ALL SELECT h.key, h.ts, h.i, CASE WHEN h.ts >= s.opened + INTERVAL 1 DAY THEN h.ts ELSE s.opened END, CASE WHEN h.ts >= s.opened + INTERVAL 1 DAY THEN 1 ELSE s.n + 1 END FROM s JOIN h ON h.key = s.key AND h.i = s.i + 1) SELECT key, ts, n, n <= 3 AS allowed FROM s")
def t1_rate_limit(spark, sf_dir):
    """Three hits a day for each user, in days that begin with a user's first hit."""
    hits = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.lit(3).alias("max"), F.lit(86_400).alias("window_seconds"))
    return jobs.rate_limit_batch(hits).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id AS project_id, max(ts) AS silent_since FROM events GROUP BY user_id HAVING arg_max(event_type, ts) <> 'error' AND max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 3600 SECOND")
def t4_detect_stuck(spark, sf_dir):
    progress = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("processing").alias("status"))
    return jobs.detect_stuck_batch(progress, at("2024-01-30 00:00:00"))


@query("""SELECT user_id AS project_id, ts AS silent_since FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error' DESC) AS next FROM events)
WHERE event_type <> 'error' AND coalesce(next, TIMESTAMP '2024-01-30 00:00:00') > ts + INTERVAL 1 DAY""")
def t4_silences(spark, sf_dir):
    """Every day in which a running project wrote nothing."""
    progress = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("processing").alias("status"))
    return jobs.silences(progress, at("2024-01-30 00:00:00"), 86_400).select("project_id", F.col("silent_since").cast("timestamp_ntz").alias("silent_since"))


@query("SELECT user_id AS subscription_id, arg_max(event_id, ts) AS event_id, max(ts) AS event_time, arg_max(event_type, ts) AS status FROM events GROUP BY user_id")
def t5_latest_subscription(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("subscription_id"), "event_id", F.col("ts").alias("event_time"), F.col("event_type").alias("status"))
    return jobs.latest_subscription(e)


@query()
def t7_redact(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("message"), F.lit("x").alias("api_key"))).alias("value"))
    return jobs.redact_stream(lines).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.api_key").alias("api_key"), F.length("value").alias("chars"))


@query(f"WITH {PROJECTS} SELECT project_id FROM projects LEFT JOIN runs USING (run_id) WHERE coalesce({CLAIM}, false)")
def p11_claimable(spark, sf_dir):
    projects, runs = projects_of(spark, sf_dir)
    return lifecycle.claimable(projects, runs, at(CLOCK)).select("project_id")


START_SQL = "CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'processing' AND coalesce(run_status IN ('pending', 'running'), updated_at >= TIMESTAMP '2001-08-01' - INTERVAL 360 SECOND) THEN 'running' WHEN code_removed_at IS NOT NULL THEN 'code_removed' WHEN status = 'failed' AND file_count = 0 THEN 'import_failed' ELSE 'claimable' END"


@query(f"WITH {PROJECTS} SELECT project_id, {START_SQL} AS start FROM projects LEFT JOIN runs USING (run_id)")
def p10_analysis_start(spark, sf_dir):
    projects, runs = projects_of(spark, sf_dir)
    return lifecycle.analysis_start(projects, runs, at(CLOCK))


@query(f"WITH {PROJECTS} SELECT project_id FROM projects WHERE status = 'processing' AND updated_at < TIMESTAMP '{CLOCK}' - INTERVAL 3600 SECOND AND run_id NOT IN (SELECT run_id FROM runs WHERE run_status IN ('pending', 'running')) ORDER BY updated_at, project_id LIMIT 100")
def w11_stuck_projects(spark, sf_dir):
    """The hundred that are stuck longest; the limit is the operator's."""
    projects, runs = projects_of(spark, sf_dir)
    return lifecycle.stuck_projects(projects, runs, at(CLOCK)).select("project_id")


IDLE_SQL = f"(code_removed_at IS NULL AND status NOT IN ('queued', 'processing') AND last_used_at < TIMESTAMP '{CLOCK}' - INTERVAL 7776000 SECOND)"


@query(f"WITH {PROJECTS} SELECT project_id FROM projects WHERE {IDLE_SQL}")
def w12_idle_projects(spark, sf_dir):
    return lifecycle.idle_projects(projects_of(spark, sf_dir)[0], at(CLOCK)).select("project_id")


@query(f"WITH {PROJECTS} SELECT status, count(*) AS n, count(*) FILTER (WHERE changed) AS changed FROM (SELECT CASE WHEN ask AND status IN ('failed', 'completed') THEN 'queued' ELSE status END AS status, ask AND status IN ('failed', 'completed') AS changed FROM (SELECT *, project_id % 2 = 0 AS ask FROM projects)) GROUP BY status")
def m4_transition(spark, sf_dir):
    projects = projects_of(spark, sf_dir)[0]
    out = lifecycle.transition(projects, projects.filter("project_id % 2 = 0").select("project_id"), "requeue", at(CLOCK))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query(f"WITH {PROJECTS} SELECT project_id, CASE WHEN project_id % 3 = 0 AND status NOT IN ('queued', 'processing') AND last_used_at < TIMESTAMP '{CLOCK}' - INTERVAL 86400 SECOND THEN TIMESTAMP '{CLOCK}' ELSE last_used_at END AS last_used_at FROM projects")
def m5_touch(spark, sf_dir):
    projects = projects_of(spark, sf_dir)[0]
    return lifecycle.touch(projects, projects.filter("project_id % 3 = 0"), at(CLOCK)).select("project_id", "last_used_at")


@query(f"WITH {PROJECTS} SELECT project_id, code_removed_at, n AS facts FROM (SELECT project_id, CASE WHEN {IDLE_SQL} THEN TIMESTAMP '{CLOCK}' ELSE code_removed_at END AS code_removed_at, {IDLE_SQL} AS idle FROM projects) p LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.k = p.project_id AND NOT idle".replace("n AS facts", "coalesce(n, 0) AS facts"))
def m6_remove_idle(spark, sf_dir):
    facts = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    projects, left = lifecycle.remove_idle(projects_of(spark, sf_dir)[0], {"files": facts}, at(CLOCK))
    counts = left["files"].groupBy("project_id").agg(F.count("*").alias("facts"))
    return projects.select("project_id", "code_removed_at").join(counts, "project_id", "left").na.fill(0, ["facts"])


ERASE_TABLES = "WITH ids AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 7 = 0), gone AS (SELECT o_orderkey FROM orders JOIN ids ON o_custkey = user_id)"


def account_tables(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    t = {
        "users": read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "projects": read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id")),
        "files": read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id")), "tokens": read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("email")),
    }
    return t, read_table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))


def sizes_of(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{ERASE_TABLES} SELECT 'users' AS table_name, count(*) AS rows FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'projects', count(*) FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'files', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'tokens', count(*) FROM customer WHERE c_custkey % 7 <> 0")
def m7_erase_accounts(spark, sf_dir):
    return sizes_of(lifecycle.erase_accounts(*account_tables(spark, sf_dir)))


@query("SELECT unnest(['users', 'projects', 'files', 'tokens']) AS table_name, 0 AS rows")
def u5_leftovers(spark, sf_dir):
    tables, users = account_tables(spark, sf_dir)
    return lifecycle.leftovers(lifecycle.erase_accounts(tables, users), users)


@query("SELECT 'calls' AS table_name, count(*) AS rows, count(*) FILTER (WHERE event_id % 100 = 3) AS nulled FROM events UNION ALL SELECT 'projects', count(*), 0 FROM orders WHERE o_orderkey % 100 <> 3")
def m8_delete_projects(spark, sf_dir):
    calls = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("project_id"))
    projects = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("project_id"))
    out = lifecycle.delete_projects({"calls": calls, "projects": projects}, calls.filter("project_id = 3").select("project_id"))
    parts = [df.agg(F.count("*").alias("rows"), F.count_if(F.col("project_id").isNull()).alias("nulled")).select(F.lit(name).alias("table_name"), "rows", "nulled") for name, df in out.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT o_custkey AS key, max(o_orderdate) AS updated_at, count(*) > 0 AS seen FROM orders GROUP BY o_custkey")
def m1_upsert_latest(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("updated_at"))
    half = F.xxhash64("key", "updated_at") % 2 == 0
    return lifecycle.upsert_latest(o.filter(half), o.filter(~half), ["key"]).withColumn("seen", F.lit(True))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem")
def m2_insert_absent(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    return lifecycle.insert_absent(rows.filter("key % 2 = 0").distinct(), rows, ["key"])


@query("SELECT o_orderkey AS project_id, o_totalprice AS health, count(l_orderkey) AS chunk_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j1_project_list(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    projects = o.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").alias("created_at"))
    reports = o.select(F.col("o_orderkey").alias("project_id"), F.col("o_totalprice").alias("health"))
    return lifecycle.project_list(projects, reports, read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))).select("project_id", "health", "chunk_count")


@query("SELECT o_orderkey AS project_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS has_chunks FROM orders")
def j3_has_chunks(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("project_id"))
    return lifecycle.with_has_chunks(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id")), chunks)


@query("SELECT l_orderkey AS project_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7")
def p1_owned(spark, sf_dir):
    projects = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
    return lifecycle.owned(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id")), projects, 7)


@query("SELECT l_suppkey AS user_id, l_partkey AS installation_id FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_partkey = l.l_partkey AND m.l_suppkey <> l.l_suppkey)")
def j14_exclusive_installs(spark, sf_dir):
    return lifecycle.exclusive_installs(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("installation_id")))


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS alive, count(*) FILTER (WHERE event_type = 'click') AS removed FROM events")
def a38_maintenance_summary(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "alive").when(F.col("event_type") == "click", "removed")
    return lifecycle.maintenance_summary(read_table(spark, sf_dir, "events").select(action.alias("action")))


SEVERITY = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'critical' WHEN 'RF' THEN 'high' WHEN 'NF' THEN 'medium' ELSE 'low' END"


def line_findings(spark, sf_dir) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    severity = F.when(kind == "AF", "critical").when(kind == "RF", "high").when(kind == "NF", "medium").otherwise("low")
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), severity.alias("severity"), F.col("l_quantity").alias("lines"))


@query(f"SELECT l_suppkey AS project_id, {', '.join(f'count(*) FILTER (WHERE {SEVERITY} = {chr(39)}{s}{chr(39)}) AS {s}' for s in ('critical', 'high', 'medium', 'low'))} FROM lineitem GROUP BY l_suppkey")
def a18_severities_of_lines(spark, sf_dir):
    return findings.count_by_severity(line_findings(spark, sf_dir))


@query("SELECT l_suppkey AS project_id, l_orderkey * 8 + l_linenumber AS ord, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber, l_partkey) AS rank FROM lineitem QUALIFY rank <= 10")
def w1_top_n(spark, sf_dir):
    l_ = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_extendedprice").alias("price"), "l_partkey")
    return rules.top_n(l_, ["project_id"], [F.desc("price"), F.col("ord"), F.col("l_partkey")], 10).select("project_id", "ord", "price", "rank")


@query("SELECT l_suppkey AS project_id, count(*) AS function_count, count(*) FILTER (WHERE l_quantity > 40) AS long_function_count FROM lineitem GROUP BY l_suppkey")
def a2_function_measures(spark, sf_dir):
    sizes = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.lit("src/a.ts").alias("file_path"), F.lit("f").alias("name"), F.col("l_quantity").alias("lines"))
    return rules.function_measures(sizes, 40)


@query("WITH s AS (SELECT l_suppkey::VARCHAR AS bundle, p_brand AS package, sum(p_size) AS bytes FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT bundle, package, bytes, row_number() OVER (PARTITION BY bundle ORDER BY bytes DESC, package) AS rank FROM s QUALIFY rank <= 12")
def a34_package_sizes(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    l_ = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    rows = l_.count()
    used = dealt_by(l_, rows, "l_partkey").join(part, "l_partkey")
    files = used.select(F.col("l_suppkey").cast("string").alias("bundle"), F.concat(F.lit("/app/node_modules/x/node_modules/"), "p_brand", F.lit("/"), F.col("l_partkey").cast("string")).alias("path"), F.col("p_size").alias("bytes"))
    return evals.package_sizes(files, rows=rows)


@query("WITH h AS (SELECT 'src/' || l_suppkey || '.ts' AS file, CASE WHEN l_linenumber <= 2 THEN 'function' ELSE 'statement' END AS kind, l_partkey::VARCHAR AS id, sum((l_quantity > 40)::INT) AS hits FROM lineitem GROUP BY ALL), f AS (SELECT file, sum((kind = 'statement')::INT) AS st, sum((kind = 'statement' AND hits > 0)::INT) AS cov, sum((kind = 'function')::INT) AS fn, sum((kind = 'function' AND hits > 0)::INT) AS ran FROM h GROUP BY file) SELECT floor(100 * sum(cov) / sum(st) + 0.5)::BIGINT AS statements_percent, sum((fn > 0)::INT) AS files_with_functions, floor(100 * sum((ran > 0)::INT) / sum((fn > 0)::INT) + 0.5)::BIGINT AS exercised_percent FROM f")
def a32_merge_coverage(spark, sf_dir):
    l_ = read_table(spark, sf_dir, "lineitem")
    hits = l_.select(F.col("l_returnflag").alias("suite"), F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("file"), F.when(F.col("l_linenumber") <= 2, "function").otherwise("statement").alias("kind"), F.col("l_partkey").cast("string").alias("id"), (F.col("l_quantity") > 40).cast("int").alias("hits"))
    return evals.merge_coverage(hits)[0]


@query("SELECT n_name AS \"case\", r_name AS metric, least_v AS least, v AS value, coalesce(v >= least_v, false) AS passed FROM (SELECT n_name, r_name, n_nationkey AS least_v, sum(c_acctbal) / 1000 AS v FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY ALL)")
def a39_check_gates(spark, sf_dir):
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    customers = read_table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    metrics = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("case"), F.col("r_name").alias("metric")).agg((F.sum("c_acctbal") / 1000).alias("value"))
    gates = nations.select(F.col("n_name").alias("case"), F.col("r_name").alias("metric"), F.col("n_nationkey").alias("least"))
    return evals.check_gates(metrics, gates).select("case", "metric", "least", "value", "passed")
