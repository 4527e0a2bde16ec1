"""Exact search among vectors, in blocks.

Queries are sent to the parts of their project's vectors. A task holds its queries as one matrix and reads the vectors as a stream
of Arrow blocks: one matrix product a block, then what may be among a query's first k goes into its list of k. What leaves a
part is k rows a query, whatever the part's size; no row for each pair of query and vector exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import top_n

#: Parts of a project's vectors, and of its queries, that tasks take for themselves.
PARTS, QUERY_PARTS = 32, 1


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines by sums in the vectors' order, as a fold over the array gives them, whatever order a matrix product sums in."""
    dot = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return dot(rows * query) / np.sqrt(dot(query * query) * dot(rows * rows))


class Tops:
    """The first k of each query so far: highest score first, ties by key."""

    def __init__(self, ids: list, vectors: list, k: int):
        self.ids, self.k = ids, k
        self.vectors = [np.array(v, dtype=np.float64) for v in vectors]
        self.found: list[list[tuple]] = [[] for _ in ids]
        # Queries of one length make one matrix of unit vectors; a vector without a direction has no cosine.
        self.groups: dict[int, tuple[list[int], np.ndarray]] = {}
        for dims in {len(v) for v in self.vectors}:
            own = [i for i, v in enumerate(self.vectors) if len(v) == dims and np.isfinite(v).all() and v.any()]
            if own:
                matrix = np.stack([self.vectors[i] for i in own])
                self.groups[dims] = (own, matrix / np.linalg.norm(matrix, axis=1, keepdims=True))

    def see(self, keys: list, vectors: list) -> None:
        by_dims: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dims.setdefault(len(v), []).append(i)
        for dims, rows in by_dims.items():
            if dims not in self.groups:
                continue
            block = np.array([vectors[i] for i in rows], dtype=np.float64)
            norms = np.linalg.norm(block, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            block, names, norms = block[good], [keys[i] for i, fine in zip(rows, good, strict=True) if fine], norms[good]
            if not names:
                continue
            own, queries = self.groups[dims]
            near = queries @ (block / norms[:, None]).T
            slack = 8 * dims * np.finfo(np.float64).eps  # more than products of unit vectors can be wrong by
            for i, scores in zip(own, near, strict=True):
                found = self.found[i]
                least = -found[-1][0] if len(found) == self.k else -np.inf
                if len(scores) > self.k:
                    least = max(least, np.partition(scores, -self.k)[-self.k])
                places = np.flatnonzero(scores >= least - slack)
                if len(places):
                    exact = exact_cosine(self.vectors[i], block[places]).tolist()
                    self.found[i] = sorted([*found, *((-s, names[p]) for s, p in zip(exact, places.tolist(), strict=True))])[: self.k]

    def rows(self) -> Iterator[tuple]:
        for query, found in zip(self.ids, self.found, strict=True):
            for down, key in found:
                yield query, key, -down


def searched(k: int, key: str):
    """Rows of (project, part, query part, query id or null, key or null, vector), sorted so that a part's queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(at: tuple, tops: Tops | None, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            rows = [(at[0], *x) for x in tops.rows()] if tops else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["project_id", "query_id", key, "score"])

        at, ids, vectors, tops, kinds = None, [], [], None, []
        for b in batches:
            kinds = [b.schema.field(c).type for c in ("project_id", "query_id", "_key")] + [pa.float64()]
            columns = {c: b[c].to_pylist() for c in ("project_id", "_part", "_turn", "query_id", "_key", "_vector")}
            places = list(zip(columns["project_id"], columns["_part"], columns["_turn"], strict=True))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1] or columns["query_id"][i] is None and columns["query_id"][i - 1] is not None), len(places)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if places[begin] != at:
                    yield from found(at, tops, kinds)
                    at, ids, vectors, tops = places[begin], [], [], None
                if columns["query_id"][begin] is not None:
                    ids += columns["query_id"][begin:end]
                    vectors += columns["_vector"][begin:end]
                elif ids:
                    tops = tops or Tops(ids, vectors, k)
                    tops.see(columns["_key"][begin:end], columns["_vector"][begin:end])
        yield from found(at, tops, kinds)

    return run


def blocked_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str, parts: int = PARTS, query_parts: int = QUERY_PARTS) -> DataFrame:
    """project_id, query_id, `key`, score, rank: each query's k nearest vectors of its own project by exact cosine, ties by key.

    queries (project_id, query_id, embedding), vectors (project_id, `key`, embedding). A vector that is null, of another length than the
    query's, without a direction or not finite is found by no query. A task holds the queries of one project and one of `query_parts`.
    """
    as_double = lambda c: F.col(c).cast("array<double>")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    query_type, key_type, project_type = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key], dict(vectors.dtypes)["project_id"]
    q = queries.filter("query_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("project_id").cast(project_type).alias("project_id"), each(parts).alias("_part"), part("query_id", query_parts).alias("_turn"), "query_id", F.lit(None).cast(key_type).alias("_key"), as_double("embedding").alias("_vector"),
    )
    asked = vectors.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull())
    v = asked.select("project_id", part(key, parts).alias("_part"), each(query_parts).alias("_turn"), F.lit(None).cast(query_type).alias("query_id"), F.col(key).alias("_key"), as_double("embedding").alias("_vector"))
    both = q.unionByName(v).repartition("project_id", "_part", "_turn").sortWithinPartitions("project_id", "_part", "_turn", F.col("query_id").isNull())
    ddl = f"project_id {project_type}, query_id {query_type}, `{key}` {key_type}, score double"
    return top_n(both.mapInArrow(searched(k, key), ddl), ["project_id", "query_id"], [F.desc("score"), F.col(key)], k)
