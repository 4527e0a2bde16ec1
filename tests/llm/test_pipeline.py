"""The pipeline, stage by stage, against brute force on small tables."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import common, quality

from .test_operators import components_truth, contamination_truth, edited, sentences


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    good = sentences(60, 80, 40)
    items = [(i, t) for i, t in enumerate(sentences(61, 5, 20))]
    texts = good + [edited(rng, good[i], 1) for i in range(15)] + good[:5] + [g + " " + items[i % 5][1] for i, g in enumerate(sentences(62, 10, 30))]
    n_good = len(texts)
    texts += [" | ".join(s.split()) for s in sentences(63, 40, 40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i < n_good), 0) for i in range(len(texts)) if rng.random() < 0.9], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, last = [(r["doc_id"], r["text"]) for r in docs.collect()], None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "quality":
            want = {r["doc_id"] for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
            assert len(want & set(range(n_good))) >= 0.95 * n_good
        elif name == "near_duplicates":
            want = {c for _, _, c in components_truth(kept)}
        elif name == "decontamination":
            want = {r[0] for r in contamination_truth(kept, items) if not r[5]}
        else:
            want = set(got)
        if name in ("quality", "near_duplicates", "decontamination"):
            assert got == Counter(want)
        elif name == "mixing":
            assert set(got) <= {i for i, _ in kept} and max(got.values()) <= 2 and sum(got.values()) > len(kept)
        else:
            last = out
            assert sum(got.values()) == out.count() == docs.count()
        if name != "sharding":
            assert out.columns == docs.columns
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        docs = out
    scratch = lambda: {d for d, _, files in os.walk(common.shared_folder(spark).removeprefix("file:")) if "_SUCCESS" in files}
    before = scratch()
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert [d.rpartition("/")[2] for d in scratch() - before] == ["4-sharding"]  # no table is left but the result
    key = lambda df: Counter((r["doc_id"], r["size"], r["shard"]) for r in df.collect())
    assert key(again) == key(last)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, _row long, _text string, words string, lines long, node long, size long, shard int, key string"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables whose documents have null ids and texts, repeated ids and rows, blank and very long texts, and clashing columns."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    good, items = sentences(70, 60, 40), sentences(71, 4, 20)
    texts = [*enumerate(good), (3, good[3]), (3, good[3]), (4, "another text under an id that is taken already"), (None, good[5] + " and a tail"), (None, None), (None, " "), (100, None), (101, ""), (102, " \n\t"), (103, " ".join(good) * 60), (104, good[7] + " " + items[0]), (None, items[1]), (105, "w" * 300_000)]
    rows = [(i, t, None if k % 9 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, 1, 2, "t", "w", 3, 4, 5, 6, "k") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(None, 0, 0), (101, 0, 0), (102, 0, None), (100, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None), (None, ""), (10, "short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def by_row(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_take_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = by_row(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, awkward)
        if name == "sharding":
            slots = [(r["shard"], r["slot"]) for r in out.collect()]
            assert len(slots) == sum(rows.values()) and sorted(s for _, s in slots if _ == slots[0][0]) == list(range(sum(_ == slots[0][0] for _, s in slots)))
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in rows.elements())
            continue
        assert out.columns == docs.columns and out.filter("row <> 1 OR _row <> 2 OR _text <> 't' OR words <> 'w' OR lines <> 3 OR node <> 4 OR size <> 5 OR shard <> 6 OR key <> 'k'").isEmpty()
        got = by_row(out)
        assert set(got) <= set(rows)
        if name == "quality":
            assert all(got[r] in (0, n) for r, n in rows.items())  # repeated rows stay or go together
        elif name == "near_duplicates":
            assert Counter(c for _, _, c in components_truth(list(rows.elements())) if c is not None).keys() == {i for i, _ in got if i is not None}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()]
            truth = contamination_truth(list(rows.elements()), items)
            assert Counter(i for i, _ in got.elements()) == Counter(r[0] for r in truth.elements() if not r[5])
        else:
            assert all((t or "").split() for _, t in got) and all(n <= 2 * rows[r] for r, n in got.items())


def test_stages_take_empty_tables(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").filter(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, awkward)
        assert out.isEmpty() and (name == "sharding" or out.columns == docs.columns)
