"""Hard negatives by a secondary-sort shuffle.

Anchors and vectors are packed into blocks of rows, and each block of anchors meets each block of vectors on a grid of
slots. A pair of blocks gives its scores by one matrix product. Of a block's scores only those leave that can be
among the first ones of all: an anchor's few best of its own label, and the few best inside each of its positives'
windows. What leaves has the key (anchor, descending score, id); rows are dealt by anchor and sorted by the whole
key inside their partitions. An iterator then reads an anchor's rows as a stream: a positive opens its window, negatives
are given out to the windows that they lie in, and only the open windows are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Bytes of a block's vectors.
BLOCK = 512 << 10
#: Scores are kept within what a long holds with either sign.
LIMIT = (1 << 63) - 1

BLOCKS = "ids array<long>, labels array<long>, dims int, data binary, lows array<array<long>>, highs array<array<long>>"
SCHEMA = pa.schema([
    ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dims", pa.int32()), ("data", pa.binary()),
    ("lows", pa.list_(pa.list_(pa.int64()))), ("highs", pa.list_(pa.list_(pa.int64()))),
])


def clean(embeddings: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """id, label, v (whole numbers: each component times `scale`, rounded down) of the rows that take part, one for each id."""
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    taken = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    units = taken.select("id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    return units.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, label, v, lows, highs), shorter vectors filled up with zeros."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors, lows, highs = zip(*rows, strict=True)
        dims = max(map(len, vectors))
        data = np.zeros((len(rows), dims), dtype=np.int64)
        for at, v in zip(data, vectors, strict=True):
            at[: len(v)] = v
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids, labels, dims, data.tobytes(), lows, highs), SCHEMA.types, strict=True)], schema=SCHEMA)

    held, size = [], 0
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("id", "label", "v", "lows", "highs")), strict=True):
            held.append(row)
            size += 8 * len(row[2]) + 8
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


def blocks_of(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<long>")
    return rows.select("id", "label", "v", *[F.col(c) if c in rows.columns else none.alias(c) for c in ("lows", "highs")]).mapInArrow(packed, BLOCKS)


def matrix(data: bytes, n: int, dims: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), dtype=np.int64)
    out[:, :dims] = np.frombuffer(data, dtype=np.int64).reshape(n, dims)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly: as doubles while no sum can pass 2**53, else by whole numbers of any length, kept within a long."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, a.shape[1]) < 1 << 53:
        return (x @ y.T).astype(np.int64)
    return np.array([[max(-LIMIT, min(LIMIT, sum(map(int.__mul__, p, q)))) for q in b.tolist()] for p in a.tolist()], dtype=np.int64).reshape(len(a), len(b))


def first(scores: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The `n` places among `of` with the highest scores, ties by smaller id."""
    if len(of) > n:
        down = -scores[of]
        of = of[down <= np.partition(down, n - 1)[n - 1]]
    return of[np.lexsort((ids[of], -scores[of]))[:n]]


PAIRS = pa.schema([("anchor_id", pa.int64()), ("down", pa.int64()), ("turn", pa.int32()), ("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
KEYS = "anchor_id long, down long, turn int, id long, low long, high long"


def scored(choose):
    """Rows of each pair of blocks: choose(scores of an anchor, whether a vector has its label, ids, whether it is the anchor, windows) gives the places that leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                width = max(x["dims"], x["_dims"])
                ids, labels = np.array(x["ids"], dtype=np.int64), np.array(x["labels"], dtype=np.int64)
                scores = products(matrix(x["_data"], len(x["_ids"]), x["_dims"], width), matrix(x["data"], len(ids), x["dims"], width))
                out: list[tuple] = []
                for row, anchor, label, lows, highs in zip(scores, x["_ids"], x["_labels"], x["_lows"], x["_highs"], strict=True):
                    for k in choose(row, labels == label, ids, ids == anchor, list(zip(lows or [], highs or [], strict=True))):
                        out.append((anchor, -int(row[k]), 1, int(ids[k]), None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PAIRS.types, strict=True)], schema=PAIRS)

    return run


def best_of_label(n: int):
    return lambda scores, same, ids, own, _: first(scores, ids, np.flatnonzero(same & ~own), n)


def best_in_windows(n: int):
    def choose(scores, same, ids, own, windows):
        found: set[int] = set()
        for low, high in windows:
            found.update(first(scores, ids, np.flatnonzero(~same & ~own & (scores >= low) & (scores <= high)), n).tolist())
        return found

    return choose


def on_grid(anchors: DataFrame, vectors: DataFrame, choose) -> DataFrame:
    """What `choose` takes of every anchor against every vector. With P shuffle partitions, a hundredth of the rows as anchors travels least to 10 sqrt(P) slots of vectors."""
    slots = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall = min(slots, math.ceil(10 * math.sqrt(slots)))
    wide = -(-slots // tall)
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["ids", "labels", "dims", "data"]
    sought = anchors.select(*[F.col(c).alias(f"_{c}") for c in [*names, "lows", "highs"]], own(wide).alias("w"), each(tall).alias("t"))
    held = vectors.select(*names, own(tall).alias("t"), each(wide).alias("w"))
    return held.hint("merge").join(sought.hint("merge"), ["t", "w"]).drop("t", "w").mapInArrow(scored(choose), KEYS)


def sorted_stream(pairs: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, sorted by (anchor, descending score, positives before negatives, id)."""
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", "down", "turn", "id")


def leading(n: int):
    """The first `n` rows of each anchor of a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            keep = []
            for k, anchor in enumerate(b["anchor_id"].to_pylist()):
                last, seen = anchor, seen + 1 if anchor == last else 1
                if seen <= n:
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64()))

    return run


MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def opened(n: int):
    """Negatives of each open window, in the stream's order; a window closes when it has `n` or the scores have passed it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = None, []
        for b in batches:
            out = []
            for anchor, down, turn, one, low, high in zip(*(b[c].to_pylist() for c in PAIRS.names), strict=True):
                if anchor != last:
                    last, windows = anchor, []
                if turn == 0:
                    windows.append([one, -down, low, high, 0])
                    continue
                windows = [w for w in windows if w[4] < n and w[2] <= -down]
                for w in windows:
                    if -down <= w[3]:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], one, w[1], -down))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), MINED.types, strict=True)], schema=MINED)

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` (id, label, v) come from `clean`; those of which `anchors` holds are anchors. An anchor's positives are its
    best `positives` rows of its label; the negatives of each are the best `negatives` rows of other labels whose score is `low`
    to `high` percent of the positive's. Ties go to the smaller id.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows that share an id the one
    with the smallest label and vector counts. Missing components count as zero, so an empty vector scores 0 with all. Scores
    that a long cannot hold are its largest or smallest. Without anchors, positives or negatives there are no rows; a positive with
    a negative score has an empty window. Other columns are not read.
    """
    vectors = cut(vectors)
    blocks = cut(blocks_of(vectors))
    chosen = vectors.filter(anchors)
    found = on_grid(blocks_of(chosen), blocks, best_of_label(positives))
    score = -F.col("down")
    # Whole numbers, rounded inwards: low * p <= 100 * s <= high * p.
    percent = lambda of, up: (F.ceil if up else F.floor)(score.cast("decimal(20,0)") * of / F.lit(100).cast("decimal(3,0)")).cast("long")
    best = cut(sorted_stream(found).mapInArrow(leading(positives), KEYS).withColumn("turn", F.lit(0)).withColumn("low", percent(low, True)).withColumn("high", percent(high, False)))
    windows = best.filter("low <= high").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))  # `positives` at most
    wanted = chosen.hint("merge").join(windows.hint("merge"), "id")
    pairs = on_grid(blocks_of(wanted), blocks, best_in_windows(negatives))
    return sorted_stream(pairs.unionByName(best)).mapInArrow(opened(negatives), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(clean(read(spark, sf_dir, "embeddings").withColumn("label", label)), F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b)::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= 10
"""
