"""Stored vectors: reuse by content hash, embedding of what is new, exact search.

chunks (project_id, file_path, content, start_line, end_line, embedding, content_hash, embedding_model); cache
(project_id, content_hash, embedding_model, embedding).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import versions
from .search import blocked_topk

TOP_K, TEXT_CUT = 8, 8000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def known_embeddings(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """project_id, content_hash, embedding of this model; a kept vector wins over a stored one."""
    cols = ["project_id", "content_hash", "embedding"]
    of = lambda df, rank: df.filter((F.col("embedding_model") == model) & F.col("embedding").isNotNull()).select(*cols, F.lit(rank).alias("rank"))
    return of(cache, 0).unionByName(of(chunks, 1)).groupBy("project_id", "content_hash").agg(F.min_by("embedding", F.struct("rank", F.xxhash64("embedding"))).alias("embedding"))


def missing_chunks(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """project_id, content_hash, content of the distinct drafts without a vector."""
    hashed = drafts.withColumn("content_hash", text.content_hash(F.col("content")))
    return hashed.select("project_id", "content_hash", "content").dropDuplicates(["project_id", "content_hash"]).join(known, ["project_id", "content_hash"], "left_anti")


def embedder(predict: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 16) -> Callable:
    """An Arrow function that embeds `content` in batches, checking the vectors' length. `predict` comes from the caller."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = []
            for i in range(0, len(f), batch):
                vectors += predict([t[:TEXT_CUT] for t in f["content"].iloc[i : i + batch]])
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the model's vectors do not have {dim} dimensions")
            yield f.assign(embedding=vectors)

    return run


def embed(df: DataFrame, predict: Callable, dim: int) -> DataFrame:
    cols = df.select("project_id", "content_hash", "content")
    return cols.mapInPandas(embedder(predict, dim), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema) + ", embedding array<float>").drop("content")


def embed_missing(drafts: DataFrame, chunks: DataFrame, cache: DataFrame, model: str, predict: Callable, dim: int, n: int | None = None) -> DataFrame:
    """Cache rows for what has no vector yet; at most n of them, in hash order, where a step may do no more."""
    todo = missing_chunks(drafts, known_embeddings(chunks, cache, model))
    return embed(todo if n is None else todo.orderBy("project_id", "content_hash").limit(n), predict, dim).withColumn("embedding_model", F.lit(model))


def reuse_vectors(drafts: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drafts with content_hash, embedding and whether it was reused; of both, the known vector counts."""
    hashed = drafts.withColumn("content_hash", text.content_hash(F.col("content")))
    keys = ["project_id", "content_hash"]
    joined = hashed.hint("merge").join(known.select(*keys, F.col("embedding").alias("_known")).hint("merge"), keys, "left").hint("merge").join(fresh.select(*keys, F.col("embedding").alias("_fresh")).hint("merge"), keys, "left")
    return joined.select(*drafts.columns, "content_hash", F.coalesce("_known", "_fresh").alias("embedding"), F.col("_known").isNotNull().alias("reused"))


def reused_count(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """project_id, reused: distinct contents that have a vector."""
    hashes = drafts.select("project_id", text.content_hash(F.col("content")).alias("content_hash")).distinct()
    return hashes.join(known, ["project_id", "content_hash"], "left_semi").groupBy("project_id").agg(F.count("*").alias("reused"))


def store_knowledge(state: DataFrame, drafts: DataFrame, cache: DataFrame, model: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new chunk table, where the drafts' projects have these drafts, and the new cache without those projects' rows."""
    vectors = reuse_vectors(drafts, known_embeddings(state, cache, model), fresh).drop("reused").withColumn("embedding_model", F.lit(model))
    done = drafts.select("project_id").distinct()
    return state.join(done, "project_id", "left_anti").unionByName(vectors.select(*state.columns)), cache.join(done, "project_id", "left_anti")


def publish_knowledge(spark: SparkSession, root: str, drafts: DataFrame, model: str, fresh: DataFrame) -> int:
    """Publishes tables `chunks` and `cache` with the drafts' projects swapped, both in one version: a reader finds the old chunks or the new ones."""
    number, _ = versions.current(spark, root)
    chunks, cache = (versions.read_version(spark, root, t, number) for t in ("chunks", "cache"))
    new_chunks, new_cache = store_knowledge(chunks, drafts, cache, model, fresh)
    return versions.publish(spark, root, {"chunks": new_chunks, "cache": new_cache}, expect=number)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """project_id, query_id, chunk key, score, rank: each query's k nearest chunks of its own project by exact cosine, ties by key."""
    return blocked_topk(queries, chunks, k, key)


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """Top-k chunks of each question with their place in the sources."""
    sources = chunks.select("project_id", key, "file_path", "start_line", "end_line", "content")
    return vector_topk(questions, chunks, k, key).hint("merge").join(sources.hint("merge"), ["project_id", key])


def first_hit_rank(topk: DataFrame, expected: DataFrame) -> DataFrame:
    """project_id, query_id, rank of the first chunk from an expected file; null for none. topk has file_path."""
    hit = topk.join(expected, ["project_id", "query_id", "file_path"], "left_semi").groupBy("project_id", "query_id").agg(F.min("rank").alias("rank"))
    return expected.select("project_id", "query_id").distinct().join(hit, ["project_id", "query_id"], "left")


def vector_drift(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Least cosine and largest difference between two sets of vectors, and whether they agree."""
    pair = a.select(key, F.col("embedding").alias("x")).join(b.select(key, F.col("embedding").alias("y")), key)
    apart = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    out = pair.agg(F.min(cosine(F.col("x"), F.col("y"))).alias("min_cosine"), F.max(apart).alias("max_diff"), F.count("*").alias("n"))
    return out.withColumn("agrees", (F.col("min_cosine") > 0.998) & (F.col("max_diff") < 0.01))
