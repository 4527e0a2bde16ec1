"""Projects over time: who may see them, what state they are in, and changes to whole tables.

projects (project_id, user_id, name, status, source, source_url, file_count, run_id, progress_total, last_used_at,
code_removed_at, created_at, updated_at). A change is a new table made of the old one and a table of requests, so it
fits a partition overwrite, or MERGE where the table format has it. Reference times are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

STALE_SECONDS, STUCK_SECONDS, IDLE_DAYS = 360, 3600, 90
LIVE_RUN = ["pending", "running"]


def owned(df: DataFrame, projects: DataFrame, user_id: object) -> DataFrame:
    """The rows whose project belongs to the user."""
    return df.join(projects.filter(F.col("user_id") == F.lit(user_id)).select("project_id"), "project_id", "left_semi")


def run_state(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects with `run_status` of their run (run_id, run_status), if it is known."""
    return projects.join(runs, "run_id", "left")


def can_claim(now: Column) -> Column:
    """Queued; failed with files; or processing by a run that is over, or unknown and long silent."""
    has_code = F.col("code_removed_at").isNull()
    silent = text.older_than(F.col("updated_at"), now, STALE_SECONDS)
    dead = F.when(F.col("run_status").isNotNull(), ~F.col("run_status").isin(*LIVE_RUN)).otherwise(silent)
    status = F.col("status")
    return F.coalesce(has_code & ((status == "queued") | ((status == "failed") & (F.col("file_count") > 0)) | ((status == "processing") & dead)), F.lit(False))


def claimable(projects: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    return run_state(projects, runs).filter(can_claim(now)).select(projects.columns)


def analysis_start(projects: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """project_id and `start`: what a request to analyse a project meets. A run whose status is known beats the clock."""
    live = F.when(F.col("run_status").isNotNull(), F.col("run_status").isin(*LIVE_RUN)).otherwise(~text.older_than(F.col("updated_at"), now, STALE_SECONDS))
    start = (
        F.when(F.col("status") == "completed", "completed").when((F.col("status") == "processing") & live, "running").when(F.col("code_removed_at").isNotNull(), "code_removed")
        .when((F.col("status") == "failed") & (F.coalesce("file_count", F.lit(0)) == 0), "import_failed").otherwise("claimable")
    )
    return run_state(projects, runs).select("project_id", start.alias("start"))


def existing_imports(candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """Candidates (user_id, source, source_url, name) with an earlier import that did not fail: of the same repository by URL, or of the same archive by name."""
    key = F.when(F.col("source") == "github", F.lower("source_url")).otherwise(F.col("name"))
    earlier = projects.filter("status <> 'failed'").select("user_id", "source", key.alias("_key")).distinct()
    return candidates.withColumn("_key", key).join(earlier, ["user_id", "source", "_key"], "left_semi").drop("_key")


def stuck_projects(projects: DataFrame, runs: DataFrame, now: Column, seconds: int = STUCK_SECONDS, most: int = 100) -> DataFrame:
    """Processing, silent for an hour and without a live run; the oldest first."""
    live = runs.filter(F.col("run_status").isin(*LIVE_RUN)).select("run_id")
    silent = projects.filter((F.col("status") == "processing") & text.older_than(F.col("updated_at"), now, seconds))
    return silent.join(live, "run_id", "left_anti").select(projects.columns).orderBy("updated_at", "project_id").limit(most)


def idle_projects(projects: DataFrame, now: Column, days: int = IDLE_DAYS, most: int | None = None) -> DataFrame:
    """With code and unused for three months, not at work; the least recently used first."""
    idle = projects.filter(F.col("code_removed_at").isNull() & ~F.col("status").isin("queued", "processing") & text.older_than(F.col("last_used_at"), now, days * 86_400)).orderBy("last_used_at", "project_id")
    return idle if most is None else idle.limit(most)


def in_order(df: DataFrame, col: str, n: int, newest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(col) if newest else F.asc(col)).limit(n)


def share_active(now: Column) -> Column:
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def shared_reports(shares: DataFrame, projects: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """token_hash with project and report of the active shares."""
    return shares.filter(share_active(now)).select("token_hash", "project_id").join(projects.select("project_id", "name"), "project_id").join(reports, "project_id")


def shareable(projects: DataFrame, reports: DataFrame) -> DataFrame:
    return projects.filter("status = 'completed'").join(reports, "project_id", "left_semi")


def project_list(projects: DataFrame, reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Projects with health score and number of chunks, the newest first."""
    counts = chunks.groupBy("project_id").agg(F.count("*").alias("chunk_count"))
    joined = projects.join(reports.select("project_id", "health"), "project_id", "left").join(counts, "project_id", "left")
    return joined.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy(F.desc("created_at"), "project_id")


def project_summary(projects: DataFrame, reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """As `project_list`, with the number of issues of the report's array."""
    issues = reports.select("project_id", F.size("issues").alias("issue_count"))
    return project_list(projects, reports, chunks).join(issues, "project_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def with_has_chunks(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    return projects.join(chunks.select("project_id").distinct().withColumn("_c", F.lit(True)), "project_id", "left").withColumn("has_chunks", F.col("_c").isNotNull()).drop("_c")


def installation_for(projects: DataFrame, installs: DataFrame) -> DataFrame:
    """Projects with the first installation (by creation) of their owner's account, whatever its case."""
    lowered = installs.withColumn("_owner", F.lower("account_login")).withColumn("_n", F.row_number().over(Window.partitionBy("user_id", F.lower("account_login")).orderBy("created_at", "installation_id"))).filter("_n = 1")
    return projects.withColumn("_owner", F.lower("owner")).join(lowered.select("user_id", "_owner", "installation_id"), ["user_id", "_owner"], "left").drop("_owner")


def exclusive_installs(installs: DataFrame) -> DataFrame:
    """Links of installations that no other user links."""
    other = installs.select(F.col("installation_id").alias("_i"), F.col("user_id").alias("_u"))
    return installs.join(other, (F.col("installation_id") == F.col("_i")) & (F.col("user_id") != F.col("_u")), "left_anti")


# Changes to tables


def upsert_latest(state: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """One row per key: the latest by `order`; of equals, the change."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def insert_absent(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return state.unionByName(rows.dropDuplicates(keys).join(state.select(*keys), keys, "left_anti").select(state.columns))


#: Name of a transition -> (the states it needs, the state it sets).
TRANSITIONS = {"requeue": (["failed", "completed"], "queued"), "fail": (["queued", "processing", "importing"], "failed"), "cancel": (["queued", "processing"], "failed"), "complete": (["processing"], "completed")}


def transition(projects: DataFrame, requests: DataFrame, name: str, now: Column) -> DataFrame:
    """Projects after the transition of those requested (project_id) that are in a state for it; `changed` tells which were."""
    needs, sets = TRANSITIONS[name]
    asked = requests.select("project_id").distinct().withColumn("_asked", F.lit(True))
    joined = projects.join(asked, "project_id", "left").withColumn("changed", F.coalesce(F.col("_asked") & F.col("status").isin(*needs), F.lit(False)))
    return joined.withColumns({"status": F.when(F.col("changed"), sets).otherwise(F.col("status")), "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at"))}).drop("_asked").select(*projects.columns, "changed")


def claim(projects: DataFrame, requests: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Projects with the requested ones (project_id, new_run_id) that can be claimed set to processing by their new run."""
    joined = run_state(projects, runs).join(requests.groupBy("project_id").agg(F.min("new_run_id").alias("new_run_id")), "project_id", "left").withColumn("changed", F.col("new_run_id").isNotNull() & can_claim(now))
    sets = {"status": F.lit("processing"), "run_id": F.col("new_run_id"), "updated_at": now}
    return joined.withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in sets.items()}).select(*projects.columns, "changed")


def touch(projects: DataFrame, visits: DataFrame, now: Column) -> DataFrame:
    """last_used_at of visited projects, at most once a day and not while they are at work."""
    seen = visits.select("project_id").distinct().withColumn("_v", F.lit(True))
    due = F.col("_v") & ~F.col("status").isin("queued", "processing") & (F.col("last_used_at").isNull() | text.older_than(F.col("last_used_at"), now, 86_400))
    return projects.join(seen, "project_id", "left").withColumn("last_used_at", F.when(F.coalesce(due, F.lit(False)), now).otherwise(F.col("last_used_at"))).select(projects.columns)


def remove_idle(projects: DataFrame, facts: dict[str, DataFrame], now: Column, days: int = IDLE_DAYS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Projects marked as without code, and the fact tables without their rows; reports are not among the facts and stay."""
    idle = idle_projects(projects, now, days).select("project_id")
    marked = projects.join(idle.withColumn("_i", F.lit(True)), "project_id", "left").withColumn("code_removed_at", F.when(F.col("_i"), now).otherwise(F.col("code_removed_at"))).select(projects.columns)
    return marked, {name: df.join(idle, "project_id", "left_anti") for name, df in facts.items()}


def erase_accounts(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """All tables without the users (user_id, email), their projects and what belongs to those; tokens go by email."""
    ids = users.select("user_id")
    gone = tables["projects"].join(ids, "user_id", "left_semi").select("project_id")
    out = {}
    for name, df in tables.items():
        if "user_id" in df.columns:
            df = df.join(ids, "user_id", "left_anti")
        elif "project_id" in df.columns:
            df = df.join(gone, "project_id", "left_anti")
        elif "email" in df.columns:
            df = df.join(users.select("email"), "email", "left_anti")
        out[name] = df
    return out


def delete_projects(tables: dict[str, DataFrame], ids: DataFrame, keep: tuple[str, ...] = ("calls",)) -> dict[str, DataFrame]:
    """All tables without the projects; the kept ones keep their rows, with the project nulled."""
    gone = ids.select("project_id").distinct()
    out = {}
    for name, df in tables.items():
        if name in keep:
            marked = df.join(gone.withColumn("_g", F.lit(True)), "project_id", "left")
            out[name] = marked.withColumn("project_id", F.when(F.col("_g").isNull(), F.col("project_id"))).select(df.columns)
        else:
            out[name] = df.join(gone, "project_id", "left_anti") if "project_id" in df.columns else df
    return out


def leftovers(tables: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    """table_name, rows: how many rows of each table still hold an erased id or email; 0 everywhere after an erasure."""
    parts = []
    for name, df in tables.items():
        keys = [k for k in ("user_id", "email") if k in df.columns]
        held = [df.join(users.select(k), k, "left_semi") for k in keys] or [df.limit(0)]
        parts += [h.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for h in held]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.sum("rows").alias("rows"))


def fail_stuck(projects: DataFrame, stuck: DataFrame, now: Column) -> DataFrame:
    """Projects with the stuck ones failed, and why: by whether their files were read."""
    marked = projects.join(stuck.select("project_id").withColumn("_s", F.lit(True)), "project_id", "left")
    why = F.when(F.coalesce("file_count", F.lit(0)) > 0, "The analysis stopped before finishing. Please try again.").otherwise("The import did not finish. Please create the project again.")
    error = F.when(F.col("_s"), why).otherwise(F.col("error") if "error" in projects.columns else F.lit(None))
    return marked.withColumns({"error": error, "status": F.when(F.col("_s"), "failed").otherwise(F.col("status")), "updated_at": F.when(F.col("_s"), now).otherwise(F.col("updated_at"))}).drop("_s")


def revoke(state: DataFrame, requests: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows with those requested revoked now, unless they were before."""
    asked = requests.select(key).distinct().withColumn("_r", F.lit(True))
    return state.join(asked, key, "left").withColumn("revoked_at", F.when(F.col("_r") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).select(state.columns)


def cancel_subscriptions(users: DataFrame, ended: DataFrame) -> DataFrame:
    """Users whose subscription (user_id) has ended, on the free plan and without it."""
    gone = ended.select("user_id").distinct().withColumn("_ended", F.lit(True))
    sets = {"plan": F.lit("free"), "plan_status": F.lit("canceled"), "subscription_id": F.lit(None), "price_id": F.lit(None)}
    joined = users.join(gone, "user_id", "left")
    return joined.withColumns({c: F.when(F.col("_ended"), v).otherwise(F.col(c)) for c, v in sets.items()}).select(users.columns)


def split_scores(reports: DataFrame) -> DataFrame:
    """project_id, scores (category -> number), summaries (category -> redacted text), skip_reason of reports with category_scores as stored: JSON of all three."""
    stored = F.col("category_scores")
    keys = F.filter(F.json_object_keys(stored), lambda k: ~k.isin("summaries", "aiReviewSkipped"))
    scores = F.map_filter(F.from_json(stored, "map<string,string>"), lambda k, v: F.array_contains(keys, k))
    summaries = F.from_json(F.get_json_object(stored, "$.summaries"), "map<string,string>")
    return reports.select(
        "project_id", F.transform_values(scores, lambda k, v: v.cast("double")).alias("scores"), F.transform_values(summaries, lambda k, v: text.redact_public(v)).alias("summaries"),
        F.get_json_object(stored, "$.aiReviewSkipped").alias("skip_reason"))


def refund(usage: DataFrame, refunds: DataFrame) -> DataFrame:
    return usage.join(refunds, "event_id", "left_anti")


def clear_column(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.lit(None).cast(df.schema[col].dataType))


def maintenance_summary(actions: DataFrame) -> DataFrame:
    """checked, failed, alive, removed of maintenance actions (action)."""
    return actions.agg(F.count("*").alias("checked"), *[F.count_if(F.col("action") == a).alias(a) for a in ("failed", "alive", "removed")])


def classify_failures(steps: DataFrame, attempts: int = 3) -> DataFrame:
    """Failed steps (kind, attempt) as fatal, to be tried again, or given up on at the last attempt."""
    fatal = F.col("kind").isin("cancelled", "user_error")
    return steps.withColumn("verdict", F.when(fatal, "fatal").when(F.col("attempt") >= attempts, "given_up").otherwise("retry"))


def analysis_durations(projects: DataFrame, reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """project_id, files, chunks, seconds from project to report, and seconds a chunk."""
    counts = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    made = projects.select("project_id", "file_count", "created_at").join(reports.select("project_id", F.col("created_at").alias("reported_at")), "project_id").join(counts, "project_id", "left")
    seconds = F.col("reported_at").cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")
    return made.select("project_id", "file_count", F.coalesce("chunks", F.lit(0)).alias("chunks"), seconds.alias("seconds"), (seconds / F.nullif(F.col("chunks"), F.lit(0))).alias("seconds_a_chunk"))
