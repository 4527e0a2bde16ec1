"""Streams against their batch forms: shuffled micro-batches, late and repeated rows, restarts from a checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.operators import chunks, vectors
from auditlake.sources import versions
from auditlake.streaming import jobs

T = dt.datetime(2026, 1, 1)


def batches(spark, folder, rows, schema, size):
    """`rows` as micro-batches of `size`, one file each, in the given order."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(stream, folder, name, mode="append"):
    stream.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / "cp")).option("path", str(folder / "out")).start().awaitTermination()


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_rate_limit_in_order_after_a_restart(spark, tmp_path, zone):
    """Hits are dealt in disorder, the stream stops half way, and goes on from its checkpoint with windows and waiting hits kept."""
    schema, rng = "key string, ts timestamp, max int, window_seconds int", random.Random(1)
    hits = [(rng.choice("abc"), T + dt.timedelta(seconds=7 * i), 2, 60) for i in range(60)]
    # Neighbours in time change places, within the watermark's delay.
    dealt = sorted(hits, key=lambda x: x[1] + dt.timedelta(seconds=rng.randrange(100)))
    ends = [("z", T + dt.timedelta(hours=h), 1, 60) for h in (10, 20)]  # later hits, so that the watermark passes all others
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for part in (dealt[:31], dealt[31:] + ends):
            batches(spark, tmp_path, part, schema, 4)
            run(jobs.rate_limit(source(spark, tmp_path, schema), "5 minutes", ordered=True), tmp_path, "ordered")
        key = lambda df: sorted((r["key"], r["ts"], r["n"], r["allowed"]) for r in df.filter("key <> 'z'").collect())
        want = key(jobs.rate_limit_batch(spark.createDataFrame(hits, schema)))
        assert key(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) == 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_verdicts_at_once_after_a_restart(spark, tmp_path):
    schema = "key string, ts timestamp, max int, window_seconds int"
    hits = [("k", T + dt.timedelta(seconds=s), 2, 100) for s in (0, 10, 20, 90, 100, 130, 199, 200, 500)]
    for part in (hits[:3], hits[3:]):
        batches(spark, tmp_path, part, schema, 2)
        run(jobs.rate_limit(source(spark, tmp_path, schema)), tmp_path, "at_once")
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()] == [1, 2, 3, 4, 1, 2, 3, 1, 1]


def test_silences_in_shuffled_batches(spark, tmp_path):
    schema, rng = "project_id long, ts timestamp, status string", random.Random(2)
    writes = [(rng.randrange(4), T + dt.timedelta(minutes=3 * i), rng.choice(["processing"] * 5 + ["failed"])) for i in range(80)]
    writes += [(1, writes[7][1], "completed"), (1, writes[7][1], "processing"), (None, T, "processing")]
    dealt = sorted(writes, key=lambda x: x[1] + dt.timedelta(minutes=rng.randrange(20)))
    end = (9, T + dt.timedelta(days=3), "failed")
    for part in (dealt[:40], [*dealt[40:], end, (9, T + dt.timedelta(days=4), "failed")]):
        batches(spark, tmp_path, part, schema, 5)
        run(jobs.detect_stuck(source(spark, tmp_path, schema), 900, "30 minutes"), tmp_path, "silent")
    key = lambda df: sorted((r["project_id"], r["silent_since"]) for r in df.collect())
    want = key(jobs.silences(spark.createDataFrame([*writes, end], schema), F.lit(T + dt.timedelta(days=3)), 900))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) > 5


def test_counters_with_late_and_repeated_rows(spark, tmp_path, monkeypatch):
    """Micro-batches in disorder: late rows are counted, repeated ones count once, and a batch that failed before its pointer is run again without a trace."""
    rng = random.Random(6)
    schema = "event_id long, user_id long, input_tokens long, output_tokens long, created_at timestamp"
    rows = [(rng.randrange(90), 0, rng.randrange(9), 1, T + dt.timedelta(hours=rng.randrange(200))) for _ in range(120)]
    rows = [(i, i % 5, i % 9, 1, T + dt.timedelta(hours=i * 37 % 200)) for i, *_ in rows]  # a repeated id is the same event
    root, delay = str(tmp_path / "root"), 60 * 3600
    dealt = [[(*r, n // 12) for n, r in enumerate(rows)][k : k + 12] for k in range(0, 120, 12)]
    real, failures = versions.point, iter([False, False, True, False, False, True])

    def point(*args):
        if next(failures, False):
            raise OSError("the writer stops before its pointer")
        real(*args)

    monkeypatch.setattr(versions, "point", point)
    for part in dealt:
        before = versions.current(spark, root)
        spark.createDataFrame([r[:-1] for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(3):
            try:
                jobs.sync_counters(source(spark, tmp_path, schema), root, delay, str(tmp_path / "cp")).awaitTermination()
                break
            except Exception:  # noqa: BLE001
                assert versions.current(spark, root) == before  # readers still see the old version
    table = spark.createDataFrame([r for part in dealt for r in part], schema + ", batch long")
    counters, late = jobs.late_counters(table, delay)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(versions.read_version(spark, root, "counters").select("user_id", "day", "tokens", "calls")) == key(counters.select("user_id", "day", "tokens", "calls"))
    got = key(versions.read_version(spark, root, "late").select("batch", "late", "repeated"))
    assert got == key(late) and sum(r[1] for r in got) > 10 and sum(r[2] for r in got) > 10


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    frame = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    read = lambda t, n=None: sorted(r["x"] for r in versions.read_version(spark, root, t, n).collect())
    assert versions.current(spark, root) == (0, {})
    assert versions.publish(spark, root, {"a": frame(1), "b": frame(7)}) == 1
    with monkeypatch.context() as m:
        m.setattr(versions, "point", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            versions.publish(spark, root, {"a": frame(2), "b": frame(8)})
    assert read("a") == [1] and read("b") == [7]
    assert versions.change(spark, root, "a", lambda df: df.unionByName(frame(3)), batch=5) == 2
    assert read("a") == [1, 3] and read("b") == [7] and read("a", 1) == [1]
    assert versions.publish(spark, root, {"a": frame(9)}, batch=5) == 2 and read("a") == [1, 3]  # the batch has been published
    with pytest.raises(ValueError):
        versions.publish(spark, root, {"a": frame(9)}, expect=1)
    with pytest.raises(KeyError):
        read("c")
    assert versions.drop_old(spark, root, keep=1) == 3 and read("a") == [1, 3] and read("b") == [7]


def test_knowledge_is_swapped_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    of = lambda rows: spark.createDataFrame(rows, "project_id string, content string, content_hash string, embedding array<float>, embedding_model string")
    old = of([("p", "old", "h", [1.0], "m"), ("q", "same", "h", [1.0], "m")])
    cache = of([("p", "", "k", [2.0], "m")]).drop("content")
    versions.publish(spark, root, {"chunks": old, "cache": cache})
    drafts = spark.createDataFrame([("p", "new")], "project_id string, content string")
    fresh = drafts.select("project_id", text.content_hash(F.col("content")).alias("content_hash"), F.array(F.lit(5.0)).cast("array<float>").alias("embedding"))
    with monkeypatch.context() as m:
        m.setattr(versions, "point", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            vectors.publish_knowledge(spark, root, drafts, "m", fresh)
    assert sorted(r["content"] for r in versions.read_version(spark, root, "chunks").collect()) == ["old", "same"]
    vectors.publish_knowledge(spark, root, drafts, "m", fresh)
    assert {(r["content"], r["embedding"][0]) for r in versions.read_version(spark, root, "chunks").collect()} == {("new", 5.0), ("same", 1.0)}
    assert versions.read_version(spark, root, "cache").count() == 0


def test_extractors_are_checked(spark):
    files = spark.createDataFrame([("p", "a.ts", "fé\ngo"), ("p", "b.ts", None), ("q", "c.ts", "")], "project_id string, path string, content string")
    got = chunks.extracted_spans(files, lambda path, content: [("function_declaration", path, 0, 2, 1, 1), ("class", None, 3, 5, 2, 2)] if content else [])
    assert [(r["file_path"], r["node_type"], r["name"], r["start_offset"], r["end_line"]) for r in got.orderBy("start_offset").collect()] == [("a.ts", "function_declaration", "a.ts", 0, 1), ("a.ts", "class", None, 3, 2)]
    assert [r["content"] for r in chunks.chunk_spans(files, got.drop("name")).orderBy("seq").collect()] == ["fé", "go"]
    for bad in (("f", None, 0, 99, 1, 1), ("f", None, 3, 2, 1, 1), ("f", None, 0, 1, 1, 3), (None, None, 0, 1, 1, 1), ("f", None, 0, 1.5, 1, 1), ("f", 0, 1)):
        with pytest.raises(Exception, match="does not fit"):
            chunks.extracted_spans(files, lambda path, content, bad=bad: [bad]).collect()
