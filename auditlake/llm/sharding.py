"""Sharding by sampled splitters.

Records are ordered by a key, here the hash of their text and then their identifier, so equal texts are
neighbours. A sample of keys, drawn with chances in proportion to the records' sizes, gives quantiles; they cut
the key space into many ranges of about equal bytes. Ranges that turn out overfull are cut again by a sample of
their own. Each range is ordered by one task. The ranges' sums tell which texts are large and place every record
in the whole order, from which the shards are filled. Built-in functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of

SHARDS, RANGES, SAMPLE = 16, 1024, 16_384
#: Texts of more than this part of an equal share are placed first; and how many equal shares a shard may have by them.
LARGE, NEAR = 50, 1.02
LOWEST = -(2**63)


#: A record's place in the whole order: text, identifier, and a number that tells repeated rows apart.
KEY = ("high", "low", "tie")


def range_of(key: tuple[Column, ...], splitters: list[tuple[int, ...]]) -> Column:
    """How many of the sorted splitters are at or below the key: a binary search."""
    if not splitters:
        return F.lit(0)
    parts = [F.from_json(F.lit(json.dumps(list(part))), "array<bigint>") for part in zip(*splitters, strict=True)]

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["a"] + state["b"]) / 2).cast("int")
        at = F.struct(*[F.get(part, mid).alias(c) for part, c in zip(parts, KEY, strict=True)]) <= F.struct(*[x.alias(c) for x, c in zip(key, KEY, strict=True)])
        live = state["a"] < state["b"]
        return F.struct(F.when(live & at, mid + 1).otherwise(state["a"]).alias("a"), F.when(live & ~at, mid).otherwise(state["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(splitters)).alias("b")), halve, lambda s: s["a"])


def sampled(rows: DataFrame, count: int, seed: int, weight: Column | None = None) -> list[tuple[int, ...]]:
    """Keys of `count` rows, drawn without replacement with chances in proportion to size, or to `weight` (the earliest of exponential clocks).

    About twice `count` clocks are below the time kept here, over all tasks together, so few rows are sent to be ordered.
    """
    weighed = rows.select(*KEY, (F.col("size").cast("double") if weight is None else weight).alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 1
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY), 11) + 1) / F.lit(float(2**53 + 1))
    clocks = weighed.select(*KEY, (-F.log(even) / F.col("weight")).alias("clock")).filter(F.col("clock") <= 2.0 * count / total)
    return sorted(tuple(r[c] for c in KEY) for r in clocks.orderBy("clock", *KEY).limit(count).collect())


def ranged(rows: DataFrame, ranges: int = RANGES, sample: int = SAMPLE, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """`rows` (high, low, tie, size) with their `range`, and the ranges' sums: range, bytes, rows, first, last. At most 10 * `ranges` ranges.

    Splitters stand between texts (before one, and before whatever follows it), so a text lies in one range. A range is overfull by its
    bytes or by its rows, of which short texts may have very many; only one that holds nothing else than a text is cut further, by
    identifier and then between repeated rows.
    """
    keys = sampled(rows, sample, seed)
    step = max(1, len(keys) // ranges)
    splitters = sorted({(key[0], LOWEST, LOWEST) for key in keys[step::step]})
    for again in range(1, 5):
        placed = rows.withColumn("range", range_of(tuple(F.col(c) for c in KEY), splitters))
        sums = cut(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last")))
        total, count = sums.agg(F.sum("bytes"), F.sum("rows")).first()
        full = (F.col("bytes") > 2 * (total or 0) / ranges) | (F.col("rows") > 2 * (count or 0) / ranges)
        over = sums.filter(full & (F.col("first") < F.col("last"))).select("range", "first.high", F.expr("first.high = last.high").alias("alone")).collect()
        if not over:
            break
        # Bytes and rows weigh alike here, as either may be what is too much.
        weight = F.col("size") * (count / total) + 1
        keys = sampled(placed.filter(F.col("range").isin([r["range"] for r in over])), sample, seed + again, weight)
        alone, wanted, before = {r["high"] for r in over if r["alone"]}, max(1, len(keys) // ranges), len(splitters)
        more = {k for key in keys[wanted // 2 :: wanted] for k in ([key] if key[0] in alone else [(key[0], LOWEST, LOWEST), (min(key[0] + 1, 2**63 - 1), LOWEST, LOWEST)])}
        splitters = sorted({*splitters, *more})
        if len(splitters) == before:
            break
    return placed, sums


def arranged(sums: list[tuple[int, int, int, int]], shards: int) -> tuple[list[tuple[int, int | None, bool, int]], list[int]]:
    """(range, its shard or null, whether its text may be cut, bytes of the flow before it) of ranges (range, bytes, first and last text); and where in the flow each further shard begins.

    Texts of more than a LARGE-th of an equal share go whole, the largest first, to the shard with the least, where
    that shard then has no more than NEAR shares. All else is a flow in key order that fills the shards up to equal
    shares; of it only the large texts that found no shard are cut.
    """
    alone: dict[int, list[int]] = {}
    for _, size, first, last in sums:
        if first == last:
            alone.setdefault(first, []).append(size)
    share = sum(size for _, size, _, _ in sums) / shards
    large = {text: sum(sizes) for text, sizes in alone.items() if sum(sizes) * LARGE > share or len(sizes) > 1}
    loads, home = [0] * shards, {}
    for text, size in sorted(large.items(), key=lambda x: (-x[1], x[0])):
        least = min(range(shards), key=lambda k: (loads[k], k))
        if loads[least] + size <= NEAR * share:
            loads[least] += size
            home[text] = least
    out, flow = [], 0
    for number, size, first, last in sorted(sums):
        shard = home.get(first) if first == last else None
        out.append((number, shard, first == last and first in large, flow))
        flow += size if shard is None else 0
    room = [max(0.0, share - load) for load in loads]
    begins = [int(flow * sum(room[:k]) / (sum(room) or 1)) for k in range(1, shards)]
    return out, begins


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and 1 more (a null text: 1). The law is `bytes`: shards are near an equal share.
    Copies of a text stay in one shard; only a text whose copies cannot lie near an equal share (whose shard would
    have more than NEAR of it) is cut, by identifier. A small text goes where the middle of its copies lies, so a shard
    differs from its share by less than a LARGE-th on either side. slot numbers a shard's documents from 0 without
    gaps, in key order. Null and empty texts are equal texts. Null ids come first among equal texts; repeated rows have
    slots of their own and may lie in ranges of their own. An empty table gives no rows. Extra columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("high"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("low"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    # Written once, so that repeated rows keep their numbers whatever is computed again.
    placed, sums = ranged(cut(rows), ranges, sample)
    # One row for each range, of which `ranged` has a bounded number.
    found = [tuple(r) for r in sums.select("range", "bytes", "first.high", F.col("last.high").alias("end")).collect()]
    plan, begins = arranged(found, shards)
    table = docs.sparkSession.createDataFrame(plan, "_range int, home int, cuttable boolean, before long")
    own = "PARTITION BY range ORDER BY high, low, tie"
    at = placed.join(F.broadcast(table), F.col("range") == F.col("_range")).selectExpr(
        "*", f"before + sum(size) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS position", f"row_number() OVER ({own}) - 1 AS nth",
        "sum(size) OVER (PARTITION BY range, high) AS copies")
    at = at.selectExpr("*", "min(position) OVER (PARTITION BY range, high) AS opening")
    middle = F.when(F.col("cuttable"), F.col("position") + F.col("size") / 2).otherwise(F.col("opening") + F.col("copies") / 2)
    flowing = F.size(F.filter(F.from_json(F.lit(json.dumps(begins)), "array<bigint>"), lambda b: b <= middle))
    numbered = cut(at.select("doc_id", "size", "text_crc32", "range", F.coalesce("home", flowing).alias("shard"), "nth"))
    # Within a range the shards follow each other, so a slot is found from how many rows each range has in each shard.
    counts = numbered.groupBy(F.col("range").alias("_range"), F.col("shard").alias("_shard")).agg(F.count("*").alias("n"))
    starts = counts.selectExpr("_range", "_shard", "sum(n) OVER (PARTITION BY _shard ORDER BY _range) - sum(n) OVER (PARTITION BY _range ORDER BY _shard) AS shift")
    joined = numbered.join(F.broadcast(cut(starts)), (F.col("range") == F.col("_range")) & (F.col("shard") == F.col("_shard")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(read(spark, sf_dir, "documents"))


def op7_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `op7_sharding` what SQL can express: sizes, whether slots run from 0 without gaps, and whether the shard is within a twentieth of an equal share, or all of it one text."""
    rows = cut(op7_sharding(spark, sf_dir))
    shards = cut(rows.groupBy(F.col("shard").alias("_shard")).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"), F.min("slot").alias("_first"), F.max("slot").alias("_last"), F.count_distinct("slot").alias("_slots"), F.count_distinct("text_crc32").alias("_texts")))
    share = F.broadcast(shards.agg((F.sum("_bytes") / SHARDS).alias("_share")))
    near = (F.abs(F.col("_bytes") - F.col("_share")) <= F.col("_share") / 20) | (F.col("_texts") == 1)
    gapless = (F.col("_first") == 0) & (F.col("_last") == F.col("_n") - 1) & (F.col("_slots") == F.col("_n"))
    # One row, and one row for each shard.
    checked = F.broadcast(shards.join(share, F.lit(True)).select("_shard", near.alias("near"), gapless.alias("gapless")))
    return rows.join(checked, F.col("shard") == F.col("_shard")).select("doc_id", "size", "law", "near", "gapless")


OP7_SIZES_SQL = "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'bytes' AS law, true AS near, true AS gapless FROM documents"
