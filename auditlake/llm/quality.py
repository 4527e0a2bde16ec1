"""Quality classifier: a generalised additive model with pairwise interactions.

The score of a document is a sum of looked-up values: one table per feature (a value for each bin) and one
per chosen pair of features (a value for each pair of bins). The tables are learnt by cyclic boosting: in
every round each feature in turn gets one shallow tree on the current gradients, whose leaves are added to
its table. Features come from whole texts by built-in functions; scoring adds table entries by bin, a whole
Arrow batch at a time. Labels, language, source and identifier are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read, text_of

#: Labelled rows to learn from, at most; of more, those with the smallest hash of their identifier.
TRAIN_ROWS = 20_000
#: Predicted as good from this score on.
THRESHOLD = 0.3


def features(text: Column) -> dict[str, Column]:
    """The features of a whole text; an empty text has 0 in all of them."""
    chars, words, lines = F.length(text), F.size(F.col("words")), F.size(F.col("lines"))
    share = lambda count, of: F.when(of > 0, count / of).otherwise(0.0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    single = lambda *marks: sum(chars - F.length(F.replace(text, F.lit(m))) for m in marks)
    return {
        "log_chars": F.log1p(chars), "log_words": F.log1p(words), "word_chars": share(chars, words),
        "distinct_words": share(F.size(F.array_distinct("words")), words), "distinct_lines": share(F.size(F.array_distinct("lines")), lines),
        "words_a_line": share(words, lines), "upper": share(count(r"\p{Lu}"), chars), "digits": share(count("[0-9]"), chars),
        "stops": share(single(".", ","), words), "pipes": share(single("|"), words), "shouts": share(single("!"), words),
        "symbols": share(single("#", "$", "%", "&", "*"), words), "markup": share(single("<", ">", "{", "}", "=", "/"), words),
        "long_words": share(F.size(F.filter("words", lambda w: F.length(w) > 14)), words),
    }


NAMES = ["log_chars", "log_words", "word_chars", "distinct_words", "distinct_lines", "words_a_line", "upper", "digits", "stops", "pipes", "shouts", "symbols", "markup", "long_words"]


def with_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of `docs`, and the array column `x` of features."""
    split = docs.select(*keep, text_of(text_col).alias("_text")).withColumns({"words": F.array_remove(F.split("_text", SPACES, -1), ""), "lines": F.array_remove(F.split("_text", "\n", -1), "")})
    made = features(F.col("_text"))
    return split.select(*keep, F.array(*[made[n].cast("double") for n in NAMES]).alias("x"))


@dataclass
class Model:
    """base + sum of tables[f][bin of f] + sum of pair tables[(f, g)][bin of f, bin of g]."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[f], x[:, f], side="right"), np.searchsorted(self.pair_cuts[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def gains(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """Gain of a cut after each bin but the last, along the last axis."""
    gl, hl = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    gt, ht = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    return gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A tree over ordered bins with at most `leaves` leaves: a value for each bin."""
    spans, value = [(0, len(g))], np.zeros(len(g))
    while len(spans) < leaves:
        best = max(((float(c.max()), a, b, a + 1 + int(c.argmax())) for a, b in spans if b - a > 1 for c in [gains(g[a:b], h[a:b], smooth)]), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        spans.remove(best[1:3])
        spans += [(best[1], best[3]), (best[3], best[2])]
    for a, b in spans:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + smooth)
    return value


def quartered(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """A tree of two levels over a grid of bins: one cut on the first feature, one on the second in each half; its gain too."""
    best: tuple[np.ndarray, float] = (np.zeros(g.shape), 0.0)
    for i in range(1, g.shape[0]):
        value, gain = np.zeros(g.shape), 0.0
        for rows in (slice(0, i), slice(i, None)):
            gr, hr = g[rows].sum(0), h[rows].sum(0)
            j = 1 + int(gains(gr, hr, smooth).argmax())
            for cols in (slice(0, j), slice(j, None)):
                s, t = gr[cols].sum(), hr[cols].sum() + smooth
                value[rows, cols] = s / t
                gain += s * s / t
        if gain > best[1]:
            best = value, gain
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, pair_bins: int = 8, n_pairs: int = 8, smooth: float = 5.0) -> Model:
    """Cyclic boosting of shallow trees; without both labels among `y` the model is a constant."""
    edges = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) if len(x) else np.array([]) for f in range(len(NAMES))]
    cuts, pair_cuts = edges(bins), edges(pair_bins)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts, [], [])
    if len(set(y.tolist())) < 2:
        return model
    at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(len(NAMES))]
    total = np.full(len(x), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * shallow(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)), 4, smooth)
            table += step
            total += step[at[f]]
    small = [np.searchsorted(pair_cuts[f], x[:, f], side="right") for f in range(len(NAMES))]
    shape = lambda f, g: (len(pair_cuts[f]) + 1, len(pair_cuts[g]) + 1)

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p, (m, n) = 1 / (1 + np.exp(-total)), shape(f, g)
        cell = small[f] * n + small[g]
        return np.bincount(cell, y - p, m * n).reshape(m, n), np.bincount(cell, p * (1 - p), m * n).reshape(m, n)

    all_pairs = [(f, g) for f in range(len(NAMES)) for g in range(f + 1, len(NAMES)) if min(shape(f, g)) > 1]
    model.pairs = sorted(all_pairs, key=lambda pair: -quartered(*grid(*pair), smooth)[1])[:n_pairs]
    model.pair_tables = [np.zeros(shape(*pair)) for pair in model.pairs]
    for _ in range(rounds // 4):
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * quartered(*grid(f, g), smooth)[0]
            table += step
            total += step[small[f], small[g]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row's label may not be learnt from: crc32 of the identifier as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of `labels.quality`, from at most `rows` labelled documents that are not held out.

    A document labelled twice counts with its smaller label; labels other than 0 and 1 are not used.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The smallest hashes lie in the lowest share of them: only about twice `rows` are sent to be ordered.
    highest = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2.0 * (rows + 100) / max(1, known.count()))))
    sample = known.select(F.col("doc_id").alias("_doc"), F.col("quality").alias("_y")).filter(F.xxhash64("_doc") <= highest).orderBy(F.xxhash64("_doc"), "_doc").limit(rows)
    # At most `rows` rows of 16 bytes are sent to the executors.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"))
    got = with_features(found, ["_doc", "_y"]).orderBy(F.xxhash64("_doc"), "_doc", "x").limit(rows).toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(NAMES))
    return fit(x, got["_y"].to_numpy(dtype=float))


def scorer(model: Model):
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(np.array(b.tolist(), dtype=float).reshape(len(b), len(NAMES))))

    return F.pandas_udf(scored, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (0 or 1).

    Null and empty texts have all features 0 and a score like any other. Repeated rows and ties get equal
    scores. Without labels of both kinds every document has the same score. Null identifiers count as the
    empty text in `held_out`. Other columns of `docs` are not read.
    """
    model = train(docs, labels, rows)
    made = with_features(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), scorer(model)("x").alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that are predicted good, with all their columns, whatever their names.

    Null and empty texts have a score like any other; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = train(docs, labels, rows)
    text = text_of()
    made = features(F.col("_text"))
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    split = split.withColumns({"words": F.array_remove(F.split("_text", SPACES, -1), ""), "lines": F.array_remove(F.split("_text", "\n", -1), "")})
    x = split.select("_row", F.array(*[made[n].cast("double") for n in NAMES]).alias("x"))
    return x.filter(scorer(model)("x") >= threshold).select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
