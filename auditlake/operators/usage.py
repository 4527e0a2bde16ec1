"""Accounts: plans, quotas, usage, cost.

users (user_id, plan, plan_status, created_at), usage (event_id, user_id, type, created_at), calls (user_id,
project_id, feature, model, input_tokens, output_tokens, latency_ms, ok, created_at), prices (model, input, output:
micro-dollars a token), plans (plan, max_projects, analyses_per_day, tokens_per_day, chat_per_hour; null: no limit).
Reference times are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import kept
from .quantiles import percentiles

# List prices in dollars a million tokens (so micro-dollars a token), and plan limits.
PRICES = [("openai/gpt-oss-120b", 0.15, 0.6), ("openai/gpt-oss-20b", 0.075, 0.3)]
PLANS = [("free", 5, 5, 200_000, 20), ("premium", None, 50, 2_000_000, 200)]
STATUS = {"active": "active", "trialing": "active", "past_due": "past_due", "unpaid": "past_due", "canceled": "canceled", "incomplete_expired": "canceled", "paused": "canceled"}


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def plan_table(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, max_projects int, analyses_per_day int, tokens_per_day long, chat_per_hour int")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A caller's list, sent to every task once it is counted and is one; a longer one is joined as Spark sees fit."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most else df


def effective_plan(plan: Column, status: Column) -> Column:
    """Premium only while active or in its grace period."""
    return F.when((plan == "premium") & status.isin("active", "past_due"), "premium").otherwise("free")


def with_limits(users: DataFrame, plans: DataFrame) -> DataFrame:
    """Users with their effective plan and its limits. `plans` has a row for each plan."""
    named = users.withColumn("effective_plan", effective_plan(F.col("plan"), F.col("plan_status")))
    return named.join(small(plans.withColumnRenamed("plan", "effective_plan")), "effective_plan", "left")


def entitlements(subs: DataFrame, price_id: str) -> DataFrame:
    """Subscriptions with plan and plan_status: a known status is translated, any other counts as none; another price gives no plan."""
    status = F.lit("none")
    for theirs, ours in STATUS.items():
        status = F.when(F.col("status") == theirs, ours).otherwise(status)
    paid = (F.col("price_id") == price_id) & status.isin("active", "past_due")
    return subs.withColumns({"plan_status": status, "plan": F.when(F.coalesce(paid, F.lit(False)), "premium").otherwise("free")})


def current_subscription(subs: DataFrame) -> DataFrame:
    """A customer's live subscription, else the newest."""
    live = F.col("status").isin("active", "trialing", "past_due")
    order = Window.partitionBy("customer_id").orderBy(live.desc(), F.desc("created_at"), F.desc("subscription_id"))
    return subs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def subscription_users(subs: DataFrame, users: DataFrame) -> DataFrame:
    """Subscriptions with the user named in them, else the one with their customer id."""
    by_id = users.select(F.col("user_id").alias("_u"))
    by_customer = users.filter("customer_id IS NOT NULL").select(F.col("customer_id").alias("_c"), F.col("user_id").alias("_v"))
    joined = subs.join(by_id, F.col("meta_user_id") == F.col("_u"), "left").join(by_customer, F.col("customer_id") == F.col("_c"), "left")
    return joined.withColumn("user_id", F.coalesce("_u", "_v")).drop("_u", "_c", "_v")


def project_counts(projects: DataFrame) -> DataFrame:
    return projects.groupBy("user_id").agg(F.count("*").alias("projects"))


def analyses_since(usage: DataFrame, refunds: DataFrame, since: Column, type_: str = "analysis") -> DataFrame:
    """user_id, analyses from `since` on, without those refunded (event_id)."""
    used = usage.filter((F.col("type") == type_) & (F.col("created_at") >= since)).join(refunds, "event_id", "left_anti")
    return used.groupBy("user_id").agg(F.count("*").alias("analyses"))


def tokens_since(calls: DataFrame, since: Column) -> DataFrame:
    """user_id, tokens of all calls from `since` on, failed ones too."""
    return calls.filter(F.col("created_at") >= since).groupBy("user_id").agg(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))


def billing_snapshot(users: DataFrame, plans: DataFrame, projects: DataFrame, analyses: DataFrame, tokens: DataFrame) -> DataFrame:
    """Users with limits and what they used; 0 where nothing."""
    whole = with_limits(users, plans)
    for part in (projects, analyses, tokens):
        whole = whole.join(part, "user_id", "left")
    return whole.na.fill(0, ["projects", "analyses", "tokens"]).withColumn("is_paid", F.col("effective_plan") == "premium")


def quota_verdicts(snapshot: DataFrame) -> DataFrame:
    """user_id and whether a project, an analysis and a model call are allowed; a null limit allows all."""
    below = lambda used, limit: F.coalesce(F.col(used) < F.col(limit), F.lit(True))
    return snapshot.select(
        "user_id", "effective_plan", below("projects", "max_projects").alias("may_add_project"), below("analyses", "analyses_per_day").alias("may_analyse"), below("tokens", "tokens_per_day").alias("may_call"),
        (F.col("effective_plan") == "free").alias("can_upgrade"))


def with_price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their model's price, null for an unknown one. `prices` is a list of models."""
    return calls.join(small(prices), "model", "left")


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with cost_micro_usd, rounded; null for an unpriced model."""
    cost = text.half_up(F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")).cast("long")
    return with_price(calls, prices).withColumn("cost_micro_usd", cost).drop("price_in", "price_out")


def with_switch(df: DataFrame, switches: DataFrame) -> DataFrame:
    """`enabled` of each row's feature; a feature without a switch is on. `switches` is a list of features."""
    return df.join(small(switches), "feature", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


SHARES = {"p50": 0.5, "p95": 0.95}


def profile(df: DataFrame, by: str, values: list[str], exact: bool = True, ok: str | None = None, cost: str | None = None) -> DataFrame:
    """Median and 95th percentile of `values` by `by`; exact by counts of value ranges, or nearly so by sketches in one pass."""
    aggs = [F.count("*").alias("n")]
    if ok:
        aggs.append(F.avg((~F.col(ok)).cast("double")).alias("failed_share"))
    if cost:
        aggs.append(F.sum(cost).alias("total_cost"))
    if not exact:
        return df.groupBy(by).agg(*aggs, *[F.percentile_approx(v, F.lit(p)).alias(f"{v}_{k}") for v in values for k, p in SHARES.items()])
    # Several passes read what a profile needs, not what it is derived from.
    df = kept(df.select(*{by, *values, *filter(None, (ok, cost))}))
    places = percentiles(df, by, values, SHARES)
    sums = df.groupBy(F.col(by).alias("_by")).agg(*aggs)
    return places.hint("merge").join(sums.hint("merge"), places[by].eqNullSafe(sums["_by"])).drop("_by")


def usage_profile(calls: DataFrame, exact: bool = True) -> DataFrame:
    return profile(calls, "feature", ["input_tokens", "output_tokens", "latency_ms"], exact, "ok", "cost_micro_usd")


def stage_latency(spans: DataFrame, exact: bool = True) -> DataFrame:
    return profile(spans, "stage", ["seconds"], exact)
