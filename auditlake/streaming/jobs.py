"""Streams of events: rate limits, daily counters, enriched and redacted logs, stuck runs, subscriptions, embedding.

Late rows: the counters drop what is older than the watermark, and their batch form counts it; subscriptions keep
late rows and order them by event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle, usage, vectors
from ..operators.graph import kept
from ..sources import versions
from .keyed import DECIDED, SILENT, Limiter, OrderedLimiter, Silence, by_key, decide

#: What the batch form's Python function returns.
VERDICTS = "key string, ts timestamp, n int, allowed boolean"


def rate_limit(hits: DataFrame, delay: str = "1 hour", ordered: bool = False) -> DataFrame:
    """key, ts, n, allowed of a stream of hits (key, ts, max, window_seconds).

    Verdicts come at once, in order of time within a micro-batch; with `ordered` they wait for the watermark, and are those of
    `rate_limit_batch` however the hits are dealt to micro-batches.
    """
    found = by_key(hits, "key", "ts", delay, OrderedLimiter() if ordered else Limiter(), DECIDED)
    return found.select("key", F.timestamp_micros("at").alias("ts"), "n", "allowed")


def in_turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts on rows sorted by key and time; only the last key's window is carried from batch to batch."""
    last, start, n = None, None, 0
    for f in frames:
        for key, rows in f.groupby("key", sort=False):
            if key != last:
                last, start, n = key, None, 0
            numbers, verdicts, start, n = decide([t.timestamp() for t in rows["ts"]], list(rows["max"]), list(rows["window_seconds"]), start, n)
            yield pd.DataFrame({"key": key, "ts": rows["ts"], "n": numbers, "allowed": verdicts})


def rate_limit_batch(hits: DataFrame) -> DataFrame:
    """The same of a table. Whether a hit opens a window depends on the ones before, so a key's hits are read in turn by one task, which holds one batch of them."""
    rows = hits.filter("key IS NOT NULL").select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("max").cast("int").alias("max"), F.col("window_seconds").cast("double").alias("window_seconds"))
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(in_turn, VERDICTS)


def daily_counters(calls: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """user_id, day, tokens, calls by UTC day, of a stream or (without `delay`) a table."""
    late = calls.withWatermark("created_at", delay) if delay else calls
    sums = late.groupBy("user_id", F.window("created_at", "1 day").alias("w")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("calls"))
    return sums.select("user_id", F.col("w.start").alias("day"), "tokens", "calls")


COUNTERS, HORIZON, RECENT, LATE = "user_id long, day timestamp, tokens long, calls long", "seen timestamp", "event_id long, created_at timestamp", "batch long, late long, repeated long"


def sync_counters(calls: DataFrame, root: str, delay_seconds: int, checkpoint: str):
    """Runs what is there: daily counters in versioned tables, each micro-batch once, with late and repeated rows counted.

    calls (event_id, user_id, input_tokens, output_tokens, created_at). A row is late if an earlier batch has had one that is newer by more than
    the delay: it is left out of `counters` and counted in `late`. A repeated event_id within the delay counts once; only ids of that
    time are remembered, in `recent`. All tables of a batch are published in one version, so a batch that is run again changes nothing.
    """
    state = {"counters": COUNTERS, "horizon": HORIZON, "recent": RECENT, "late": LATE}

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at, tables = versions.current(spark, root)
        old = {t: versions.read_version(spark, root, t, at) if t in tables else spark.createDataFrame([], schema) for t, schema in state.items()}
        seen = old["horizon"].agg(F.max(F.unix_micros("seen"))).first()[0]
        oldest = None if seen is None else seen - delay_seconds * 1_000_000
        late = F.coalesce(F.unix_micros("created_at") < F.lit(oldest), F.lit(False))
        rows = kept(batch.withColumns({"late": late, "_n": F.row_number().over(Window.partitionBy("event_id").orderBy(late, "created_at", "user_id"))}))
        first = kept(rows.filter("NOT late AND _n = 1").hint("merge").join(old["recent"].select("event_id").hint("merge"), "event_id", "left_anti"))
        n, n_late, newest = rows.agg(F.count("*"), F.count_if("late"), F.max(F.unix_micros("created_at"))).first()
        counters = old["counters"].unionByName(daily_counters(first, None)).groupBy("user_id", "day").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))
        newest = max((x for x in (seen, newest) if x is not None), default=None)
        horizon = spark.range(1).select(F.timestamp_micros(F.lit(newest)).alias("seen"))
        young = F.lit(True) if newest is None else F.unix_micros("created_at") >= newest - delay_seconds * 1_000_000
        recent = old["recent"].unionByName(first.select("event_id", "created_at")).filter(young)
        counts = spark.createDataFrame([(number, n_late, n - n_late - first.count())], LATE)
        late = old["late"].unionByName(counts)
        versions.publish(spark, root, {"counters": counters, "horizon": horizon, "recent": recent, "late": late}, batch=number)

    return calls.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counters(calls: DataFrame, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(counters; batch, late, repeated) of a table whose `batch` tells in which micro-batch a row came: the batch form of `sync_counters`."""
    # Batches are few; the newest time before each is a running maximum of one row a batch.
    newest = calls.groupBy("batch").agg(F.max("created_at").alias("newest"))
    before = newest.select("batch", F.max("newest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)).alias("seen"))
    rows = calls.hint("merge").join(before.hint("merge"), "batch").withColumn("late", F.coalesce(F.col("created_at") < F.col("seen") - F.make_dt_interval(secs=F.lit(delay_seconds)), F.lit(False)))
    timely = rows.filter("NOT late").withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("batch", "created_at", "user_id")))
    counters = daily_counters(timely.filter("_n = 1"), None)
    repeated = timely.groupBy("batch").agg(F.count_if(F.col("_n") > 1).alias("repeated"))
    late = rows.groupBy("batch").agg(F.count_if("late").alias("late"))
    return counters, late.hint("merge").join(repeated.hint("merge"), "batch", "left").select("batch", "late", F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"))


def over_budget(counters: DataFrame, tokens_per_day: int) -> DataFrame:
    return counters.withColumn("over_budget", F.col("tokens") >= tokens_per_day)


def enrich_calls(calls: DataFrame, prices: DataFrame, switches: DataFrame) -> DataFrame:
    """Calls with cost and switch; prices and switches are short tables sent to every task."""
    return usage.with_switch(usage.call_costs(calls, prices), switches)


def detect_stuck(progress: DataFrame, seconds: int = lifecycle.STUCK_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """project_id, silent_since of every silence of a running project: a progress write (project_id, ts, status) that none follows for `seconds`."""
    return by_key(progress, "project_id", "ts", delay, Silence(seconds), SILENT).select("project_id", F.timestamp_micros("at").alias("silent_since"))


def silences(progress: DataFrame, now: Column, seconds: int = lifecycle.STUCK_SECONDS) -> DataFrame:
    """The same of a table, up to `now`. A project's writes are compared with the next one only; of writes at one time the one that ends the run counts."""
    writes = progress.filter("ts IS NOT NULL AND project_id IS NOT NULL").select("project_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("status") == "processing").alias("running"))
    ahead = F.lead("ts").over(Window.partitionBy("project_id").orderBy("ts", F.desc("running")))
    quiet = F.coalesce(F.unix_micros("_next") > F.unix_micros("ts") + seconds * 1_000_000, F.unix_micros(now.cast("timestamp")) > F.unix_micros("ts") + seconds * 1_000_000)
    return writes.withColumn("_next", ahead).filter("running").filter(quiet).select("project_id", F.col("ts").alias("silent_since"))


def detect_stuck_batch(progress: DataFrame, now: Column, seconds: int = lifecycle.STUCK_SECONDS) -> DataFrame:
    last = progress.groupBy("project_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("silent_since"))
    return last.filter((F.col("status") == "processing") & text.older_than(F.col("silent_since"), now, seconds)).select("project_id", "silent_since")


def latest_subscription(events: DataFrame) -> DataFrame:
    """The last event of each subscription by event time; repeated events count once."""
    order = Window.partitionBy("subscription_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    return events.dropDuplicates(["event_id"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def sync_subscriptions(events: DataFrame, read_state: Callable[[SparkSession], DataFrame], write_state: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs what is there: each micro-batch merges into the state by event time, so repeated and late events converge."""

    def merge(batch: DataFrame, number: int) -> None:
        state = read_state(batch.sparkSession)
        write_state(latest_subscription(state.unionByName(batch.select(state.columns))), number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_stream(drafts: DataFrame, read_cache: Callable[[SparkSession], DataFrame], append: Callable[[DataFrame, int], None], model: str, predict: Callable, dim: int, checkpoint: str):
    """Embeds what each micro-batch brings that the cache does not hold."""

    def run(batch: DataFrame, number: int) -> None:
        cache = read_cache(batch.sparkSession)
        chunks = cache.limit(0)
        append(vectors.embed_missing(batch, chunks, cache, model, predict, dim), number)

    return drafts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redact_stream(lines: DataFrame) -> DataFrame:
    """Log lines in JSON with sensitive keys masked and secrets in texts replaced, at every level."""
    return lines.select(text.sanitize_json(F.col("value")).alias("value"))
