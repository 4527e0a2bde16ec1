"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). Every pattern can send its
words to each of its sources: its first pass is cheap and each repetition costs more, so the costs are
convex. A flow of least cost fills the sources' quotas. What a pattern sends becomes whole passes over its
documents and, for the rest, a seeded choice: documents in the order of a hash of their identifier, up to
the words still wanted. Only sums by pattern and source reach the driver, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 17
#: Slices of a pattern's documents by hash; the order inside a slice is found by one task.
SLICES = 4096
#: Membership patterns that are summed, at most (the flow of so many takes about a minute); more are an error rather than being merged.
MAX_PATTERNS = 100_000


def fair_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is above is shared anew by weight."""
    caps, targets = [most * s for s in sizes], [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > caps[i]}
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ -= full
    return targets


class Network:
    """A flow network whose flow is raised, by shortest paths a layer at a time, to the largest that its capacities allow."""

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.room: list[int] = []
        self.arcs: list[list[int]] = []

    def node(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, a: int, b: int, room: int) -> int:
        """An arc and, with the next number, its reverse."""
        for start, end, free in ((a, b, room), (b, a, 0)):
            self.arcs[start].append(len(self.ends))
            self.ends.append(end)
            self.room.append(free)
        return len(self.ends) - 2

    def layers(self, start: int, end: int) -> list[int] | None:
        layer, line = [-1] * len(self.arcs), [start]
        layer[start] = 0
        for a in line:
            for e in self.arcs[a]:
                if self.room[e] and layer[self.ends[e]] < 0:
                    layer[self.ends[e]] = layer[a] + 1
                    line.append(self.ends[e])
        return layer if layer[end] >= 0 else None

    def fill(self, start: int, end: int) -> None:
        while layer := self.layers(start, end):
            at, path = [0] * len(self.arcs), []
            while True:
                here = self.ends[path[-1]] if path else start
                if here == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                while at[here] < len(self.arcs[here]):
                    e = self.arcs[here][at[here]]
                    if self.room[e] and layer[self.ends[e]] == layer[here] + 1:
                        path.append(e)
                        break
                    at[here] += 1
                else:
                    if not path:
                        break
                    at[self.ends[path.pop() ^ 1]] += 1


def cheapest_flow(supply: dict, quota: dict, repeats: int) -> dict:
    """Words that each pattern (a tuple of sources) sends to each of its sources: (pattern, source) -> words.

    A pattern sends up to its own words in each of `repeats` passes, a later one of which costs more. Costs stand on the
    passes alone, and a path that raises the flow takes nothing back from them; so the flow of least cost is the largest of
    first passes, raised by second ones, and so on.
    """
    net = Network()
    out, into = net.node(), net.node()
    sources = {s: net.node() for s in sorted(quota, key=repr)}
    for s, n in sources.items():
        net.arc(n, into, quota[s])
    entries, kept = {}, {}
    for p in sorted(supply, key=repr):
        n = net.node()
        entries[p] = net.arc(out, n, 0)
        kept |= {(p, s): net.arc(n, sources[s], supply[p] * repeats) for s in p}
    for _ in range(repeats):
        for p, e in entries.items():
            net.room[e] += supply[p]
        net.fill(out, into)
    return {pair: net.room[e + 1] for pair, e in kept.items()}


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, member (sorted distinct sources), size."""
    return docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("member"), word_count(text_of(text_col)).alias("size"))


def take(rows: DataFrame, sent: DataFrame, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """`rows` (doc_id, member, size) with `taken`: the words taken of each so that those of a pattern sum to `sent` (member, words, want)."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    # At most MAX_PATTERNS rows are sent to the executors.
    placed = rows.join(F.broadcast(sent), rows.member.eqNullSafe(sent._member)).drop("_member")
    placed = placed.withColumns({"_passes": F.when(F.col("words") > 0, F.floor(F.col("want") / F.col("words"))).otherwise(0), "_order": order})
    placed = placed.withColumns({"_rest": F.col("want") - F.col("_passes") * F.col("words"), "_slice": F.pmod(F.shiftrightunsigned("_order", 40), F.lit(slices))})
    sums = placed.groupBy("member", "_slice").agg(F.sum("size").alias("_sum"))
    starts = sums.selectExpr("member AS _m", "_slice AS _s", "sum(_sum) OVER (PARTITION BY member ORDER BY _slice) - _sum AS _start")
    ahead = F.expr("sum(size) OVER (PARTITION BY member, _slice ORDER BY _order, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") - F.col("size")
    both = placed.withColumn("_ahead", ahead).hint("merge").join(starts.hint("merge"), (F.col("_slice") == F.col("_s")) & F.col("member").eqNullSafe(F.col("_m")))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_ahead")))
    return both.withColumn("taken", (F.col("_passes") * F.col("size") + more).cast("long"))


def mix(docs: DataFrame, sources: Column, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, member, size, taken, and the words and target of its pattern's sources.

    `sources` is an array column; null in it is a source of its own, that comes last. Sources by code point get
    `weights` in turn and share `share` times the words of all documents; no target is above `repeats` times its
    source's words. A document gives between 0 and `repeats` times its size; the one at which a pattern reaches
    what it sends gives a part of its words. An empty or null text has size 0 and gives nothing. Repeated rows
    are documents of their own. The choice depends on identifier, size and `seed` alone, so reruns agree.
    """
    rows = cut(sized(docs, sources, id_col, text_col))
    sums = rows.groupBy("member").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {tuple(r["member"] or ()): r["words"] for r in sums}
    names = sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for p, n in supply.items() if s in p) for s in names}
    by_weight = [weights[i % len(weights)] for i in range(len(names))]
    targets = dict(zip(names, map(float, fair_targets([size[s] for s in names], by_weight, share * sum(supply.values()), repeats)), strict=True))
    flow = cheapest_flow(supply, {s: round(t) for s, t in targets.items()}, repeats)
    sent = [(list(p), n, sum(flow.get((p, s), 0) for s in p), [(s, size[s], targets[s]) for s in p]) for p, n in supply.items()]
    spark = docs.sparkSession
    table = spark.createDataFrame(sent, "_member array<string>, words long, want long, of array<struct<source:string,words:long,target:double>>")
    return take(rows, table, seed).select("doc_id", "member", "size", "taken", "of")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), F.array("source"))
    own = F.element_at("of", 1)
    return mixed.select("doc_id", "size", own["words"].alias("source_size"), own["target"].alias("target"), "taken")


def op6_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op6_mixing` that SQL can express, whether what is taken keeps to its bounds, and how much of the source is taken, which is its target to a word."""
    rows = cut(op6_mixing(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), "source").hint("merge"), F.col("doc_id") == F.col("_doc")))
    sums = rows.groupBy(F.col("source").alias("_source")).agg(F.sum("taken").alias("_taken"))
    near = F.abs(F.col("_taken") - F.col("target")) <= 1
    return rows.hint("merge").join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", F.col("taken").between(0, 2 * F.col("size")).alias("bounded"), near.alias("near"))


def op6_mix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of overlapping sources: every document belongs to its source and to its language, and may serve the quota of either.

    Per document the sum of its sources' targets, whether it keeps to its bound, and whether all quotas together are met to a word a source.
    """
    rows = cut(mix(read(spark, sf_dir, "documents"), F.array(F.col("source"), F.concat(F.lit("lang:"), F.col("lang")))))
    asked = rows.select(F.explode("of").alias("o")).groupBy(F.col("o.source").alias("source")).agg(F.max("o.target").alias("target"))
    wanted, sources = asked.agg(F.coalesce(F.sum(F.round("target")), F.lit(0.0)), F.count("*")).first()
    taken = rows.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
    both = F.aggregate("of", F.lit(0.0), lambda s, x: s + x["target"])
    return rows.select("doc_id", "size", F.size("of").alias("n_sources"), both.alias("targets"), F.col("taken").between(0, 2 * F.col("size")).alias("bounded"), F.lit(abs(taken - wanted) <= sources).alias("whole"))


OP6_OVERLAP_SQL = r"""
WITH d AS (SELECT doc_id, source, 'lang:' || lang AS tongue, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
m AS (SELECT doc_id, size, source AS s FROM d UNION ALL SELECT doc_id, size, tongue FROM d WHERE tongue IS DISTINCT FROM source),
s AS (SELECT s, sum(size) AS words, [3, 1, 2][1 + ((row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3)::INT] AS weight FROM m GROUP BY s),
o AS (SELECT *, 1.5 * (SELECT sum(size) FROM d) - sum(2 * words) OVER (ORDER BY 2.0 * words / weight, s) + 2 * words AS rest, sum(weight) OVER (ORDER BY 2.0 * words / weight DESC, s DESC) AS weights FROM s),
u AS (SELECT coalesce(max(rest / weights) FILTER (WHERE rest / weights <= 2.0 * words / weight), 1e18) AS unit FROM o)
SELECT doc_id, any_value(size) AS size, count(*)::INT AS n_sources, sum(least(2.0 * words, unit * weight))::DOUBLE AS targets, true AS bounded, true AS whole FROM m JOIN s ON m.s IS NOT DISTINCT FROM s.s, u GROUP BY doc_id
"""


OP6_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS words, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM d GROUP BY source),
o AS (SELECT *, 1.5 * (SELECT sum(size) FROM d) - sum(2 * words) OVER (ORDER BY 2.0 * words / weight, source) + 2 * words AS rest, sum(weight) OVER (ORDER BY 2.0 * words / weight DESC, source DESC) AS weights FROM s),
u AS (SELECT coalesce(max(rest / weights) FILTER (WHERE rest / weights <= 2.0 * words / weight), 1e18) AS unit FROM o)
SELECT doc_id, size, words AS source_size, least(2.0 * words, unit * weight)::DOUBLE AS target, true AS bounded, true AS near FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, u
"""


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them (a document of which a part is taken counts whole), with all their columns, whatever their names.

    Null and empty texts are taken never. Rows that share an id and a size are documents of their own of which one is
    as good as another; each is taken as often as the one of them taken most. An empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    picked = mix(docs.select("doc_id", "text", "source"), F.array("source")).filter("taken > 0")
    times = cut(picked.groupBy("doc_id", "size").agg(F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("times")))
    rows = docs.select(row, F.col("doc_id").alias("_doc"), word_count(text_of()).alias("_size"))
    joined = rows.hint("merge").join(times.hint("merge"), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_size") == F.col("size")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
