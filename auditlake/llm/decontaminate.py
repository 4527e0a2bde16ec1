"""Benchmark decontamination by a prefix-filtered set join.

A window (ten consecutive words of an item) is a set of shingles at their places. One counted pass over the
corpus orders shingles by rarity. A window must be contained whole, so its necessary prefix is its one rarest
shingle: only that is joined with the documents' shingles. Its position fixes where the window would start; it
must begin and end inside the document, and then the document's own words there must be the window's.
Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of, words_of

WINDOW, SHINGLE = 10, 5
#: Rows of the benchmark's shingles, or of its prefixes, that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of id and text), words, n_words of each document, written once for all passes."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), words_of(text_of(text_col)).alias("words"))
    return cut(words.withColumn("n_words", F.size("words").cast("long")))


def shingled(rows: DataFrame, size: int) -> DataFrame:
    """`rows` (with words and n_words) once for each run of `size` words: pos (from 0) and gram, its hash."""
    last = F.col("n_words").cast("int") - size
    at = rows.filter(last >= 0).withColumn("pos", F.explode(F.sequence(F.lit(0), last)))
    return at.withColumn("gram", F.xxhash64(F.lit(size), *[F.get("words", F.col("pos") + k) for k in range(size)]))


def windows_of(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of every item: item_id, words (a window's), n_words (how many)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(text_of(text_col)).alias("all")).filter(F.size("all") > 0)
    length = F.least(F.lit(window), F.size("all"))
    starts = items.select("item_id", "all", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("all") - length + 1)).alias("start"))
    return starts.select("item_id", F.slice("all", F.col("start"), F.col("length")).alias("words"), F.col("length").cast("long").alias("n_words")).distinct()


def occurrences(words: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Where windows occur in tokenised documents: doc_id, key, item_id, start, length. Windows of fewer words than a shingle are joined by single words."""
    items = cut(windows_of(benchmark, window))
    windows = items.select("words", "n_words").distinct()
    both = ((shingle, F.col("n_words") >= shingle), (1, F.col("n_words") < shingle))
    grams = cut(reduce(DataFrame.unionByName, [shingled(windows.filter(of), size).withColumn("size", F.lit(size)) for size, of in both]))
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # two numbers at most
    known = cut(grams.select("gram", "size").distinct())
    near = known.count() <= BROADCAST_ROWS

    # One pass over all documents for the rarity of the benchmark's shingles.
    counts = [windows.limit(0).select(F.lit(0).cast("long").alias("gram"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("n"))]
    for size in sizes:
        asked, held = known.filter(F.col("size") == size).select("gram"), shingled(words.select("words", "n_words"), size).select("gram")
        met = held.join(F.broadcast(asked), "gram") if near else held.groupBy("gram").agg(F.count("*").alias("n")).hint("merge").join(asked.hint("merge"), "gram")
        total = F.count("*") if near else F.sum("n")
        counts.append(met.groupBy("gram").agg(total.alias("n")).withColumn("size", F.lit(size)))
    rarity = reduce(DataFrame.unionByName, counts)

    # The prefix; a window with a shingle that no document holds occurs nowhere.
    rated = grams.hint("merge").join(rarity.hint("merge"), ["gram", "size"], "left")
    rarest = F.min_by(F.struct("gram", "pos"), F.struct("n", "pos")).alias("p")
    shape = rated.groupBy("words", "n_words", "size").agg(F.every(F.col("n").isNotNull()).alias("whole"), rarest).filter("whole")
    prefix = cut(shape.select("size", F.col("p.gram").alias("gram"), F.col("p.pos").alias("at"), F.col("words").alias("wanted"), F.col("n_words").alias("length")))

    # Only prefixes are joined; bounds on position and length, then the words themselves.
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words"))
    same = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length").cast("int")) == F.col("wanted")
    found = [words.limit(0).select("doc_id", "key", F.lit(0).alias("start"), "n_words", "words")]
    for size in sizes:
        asked = prefix.filter(F.col("size") == size).drop("size")
        if asked.count() <= BROADCAST_ROWS:
            at = shingled(words, size).join(F.broadcast(asked), "gram").withColumn("start", F.col("pos") - F.col("at")).filter(inside & same)
        else:
            thin = shingled(words, size).select("doc_id", "key", "n_words", "pos", "gram")
            at = thin.hint("merge").join(asked.hint("merge"), "gram").withColumn("start", F.col("pos") - F.col("at")).filter(inside)
            own = words.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "words").hint("merge")
            at = at.hint("merge").join(own, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).filter(same)
        found.append(at.select("doc_id", "key", "start", F.col("length").alias("n_words"), F.col("wanted").alias("words")))
    whole = reduce(DataFrame.unionByName, found).distinct()
    return whole.hint("merge").join(items.hint("merge"), ["words", "n_words"]).select("doc_id", "key", "item_id", "start", F.col("n_words").cast("int").alias("length"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased. An item of fewer
    words than a window is one window; an item without words has none. A word of a document is hit when any
    occurrence of a window covers it. Null and empty texts have no words and no hits. Repeated rows get equal
    results, and rows that share an id but not a text are judged each by its own text; null item ids have windows,
    but are no items to count. Without documents there are no rows, without items no hits. Extra columns are not read.
    """
    words = tokenised(docs)
    # A document's distinct spans are no more than its words, which are one row already.
    span = F.struct("start", (F.col("start") + F.col("length")).alias("stop"))
    hits = occurrences(words, benchmark, window, shingle).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set(span)).alias("spans"))
    more = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), more, lambda s: s["n"])
    marked = cut(hits.select("_doc", "_key", "items", n_hit.alias("n_hit")))
    joined = words.select("doc_id", "key", "n_words").hint("merge").join(marked.hint("merge"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` in which no window of `benchmark` occurs, with all their columns, whatever their names.

    Null and empty texts hold no window and stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    bad = cut(occurrences(tokenised(docs), benchmark, window, shingle).select("doc_id", "key").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return rows.hint("merge").join(bad.hint("merge"), (rows.key == bad.key) & F.col("row.doc_id").eqNullSafe(bad.doc_id), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (g, k)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
