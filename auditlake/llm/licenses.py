"""License scans with a positional index of rare words.

Every license template is a sequence of words, one run of which is its mandatory key phrase. The index posts, for each
template, its words of highest inverse document frequency with their offsets: so many that a file which covers enough of the
template by weight must hold two of them in their places (one, where the template is too short for that). A file's words that
are posted are looked up; a posting and the word's position give where the template would start, and only starts on which
enough postings agree are candidates. There the key phrase must stand whole, and the words in their places must be enough of the
template by weight. Built-in functions only: a file is one row throughout, and only the words' document frequencies are shuffled.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, read, text_of, words_of
from .license_texts import TEXTS

#: label, text, key phrase. Base phrases are key phrases altogether.
BASE = [("mit", "mit license", "mit license"), ("apache", "apache license", "apache license"), ("gpl", "general public license", "general public license")]
#: The share of a template's weight that a hit covers.
COVER = 0.75


def plain_words(text: str) -> list[str]:
    """As `words_of`."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def parsed(templates: list[tuple[str, str, str]]) -> list[dict]:
    """label, words, key (words of the key phrase) and at (its first place) of templates."""
    out = []
    for label, text, phrase in templates:
        words, key = plain_words(text), plain_words(phrase)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append({"label": label, "words": words, "key": key, "at": at})
    return out


def constant(value: object, type_: str) -> Column:
    """A value fixed by the templates, as a column."""
    return F.from_json(F.lit(json.dumps(value)), type_)


def place(template: int, offset: int) -> int:
    """A posting; with a word's position added, a template and where it would start, as one number."""
    return (template << 40) + 2**32 - offset


def inverse_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """log((documents + 1) / (documents with the word + 1)) of every word of the vocabulary, over all documents."""
    held = F.array_intersect(constant(vocabulary, "array<string>"), words_of(text_of(text_col)))
    # Each document counts once without a word, so one pass gives the number of documents too.
    rows = docs.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), held)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    found = {r["word"]: r["df"] for r in rows.collect()}  # one row for each word of the templates
    n = found.get(None, 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def posted(template: dict, idf: dict[str, float], most: int | None = None) -> tuple[set[str], int]:
    """The rarest words of a template that the index posts, and how many postings a hit agrees with at least.

    A hit misses less than 1 - `least` of the weight. While the posted places weigh more than that and the heaviest of them together, it
    holds two of them; where all places do not weigh so much, places that weigh more than 1 - `least` leave one.
    """
    weight = dict(zip(template["words"], template["weights"], strict=True))
    missed = (1 - template["least"]) * sum(template["weights"])
    words = sorted(weight, key=lambda w: (-idf[w], w))
    for votes in (2, 1):
        taken: set[str] = set()
        for w in words:
            taken.add(w)
            places = [weight[x] for x in template["words"] if x in taken]
            if sum(places) - (max(places) if votes == 2 else 0) > missed + 1e-9:
                return set(words[: len(taken)][:most]), votes
    return set(words[:most]), 1


def license_hits(docs: DataFrame, templates: list, base: list = BASE, text_col: str = "text", cover: float = COVER, rare: int | None = None) -> DataFrame:
    """`docs` with n_words and `hits`: of each the template's number among base + templates, start, and covered share of its weight.

    `rare` posts no more words of a template, which can lose hits; base phrases are posted by what the bound asks for in any case.
    """
    every = parsed([*base, *templates])
    vocabulary = sorted({w for t in every for w in t["words"]})
    idf = inverse_frequencies(docs, vocabulary, text_col)
    for number, t in enumerate(every):
        t["weights"] = [max(idf[w], 0.01) for w in t["words"]]
        t["least"] = 0.999999 if number < len(base) else cover
        t["posted"], t["votes"] = posted(t, idf, None if number < len(base) else rare)
    looked_up = sorted({w for t in every for w in t["posted"]}, key=lambda w: (-idf[w], w))
    posts = lambda w: [place(n, i) for n, t in enumerate(every) if w in t["posted"] for i, x in enumerate(t["words"]) if x == w]
    whole = constant([{k: v for k, v in t.items() if k != "posted"} for t in every], "array<struct<words:array<string>,key:array<string>,at:int,weights:array<double>,least:double,votes:int>>")
    postings = constant([posts(w) for w in looked_up], "array<array<bigint>>")
    order = constant(looked_up, "array<string>")

    def judged(words: Column, c: Column) -> Column:
        t, start = F.get(whole, F.shiftright(c, 40).cast("int")), (c.bitwiseAND(2**40 - 1) - 2**32).cast("int")
        begin = start + t["at"]
        phrase = (begin >= 0) & (F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        sums = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda s, i: s + F.when(F.get(words, start + i) == F.get(t["words"], i), F.get(t["weights"], i)).otherwise(0.0))
        total = F.aggregate(t["weights"], F.lit(0.0), lambda s, w: s + w)
        hit = lambda share: F.when(share >= t["least"], F.struct(F.shiftright(c, 40).cast("int").alias("template"), start.alias("start"), F.least(F.lit(1.0), share).alias("share")))
        return F.when(phrase, once(sums / total, hit))

    def agreed(starts: Column) -> Column:
        # Equal starts lie side by side; where two postings must agree, a start counts with its second.
        alone = lambda c: F.get(whole, F.shiftright(c, 40).cast("int"))["votes"] == 1
        return F.array_distinct(F.filter(starts, lambda c, k: alone(c) | F.coalesce(F.get(starts, k - 1) == c, F.lit(False))))

    def found(words: Column, asked: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(asked, w), F.struct(F.array_position(order, w).cast("int").alias("w"), i.alias("i")))), lambda p: p.isNotNull())
        starts = lambda seen: F.array_sort(F.flatten(F.transform(seen, lambda p: F.transform(F.get(postings, p["w"] - 1), lambda q: q + p["i"]))))
        return F.filter(F.transform(once(once(places, starts), agreed), lambda c: judged(words, c)), lambda h: h.isNotNull())

    def scan(words: Column) -> Column:
        # The result of an intersection keeps the order of the first array: rarest first.
        hits = once(F.array_intersect(order, words), lambda a: F.when(F.size(a) > 0, found(words, a)))
        none = F.array().cast("array<struct<template:int,start:int,share:double>>")
        return F.struct(F.size(words).cast("long").alias("n_words"), F.coalesce(hits, none).alias("hits"))

    scanned = docs.withColumn("_scan", once(words_of(text_of(text_col)), scan))
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns], "_scan.n_words", "_scan.hits")


def licenses(docs: DataFrame, templates: list = TEXTS, base: list = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased. n_base counts the
    places of all base phrases, first_word and last_word are their smallest and largest start. score is the largest
    covered share among the hits of templates and base phrases, 0 without one. Null and empty texts have no words
    and no hits; a template that begins before the text does, or ends after it, is a hit where its key phrase stands and
    enough is covered. Repeated rows get equal results; rows that share an id but not a text are judged each by its own.
    An empty table gives no rows. Other columns are not read, whatever their names. Every posted word of a file is
    looked up, so no hit depends on what else the file holds.
    """
    rows = license_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), templates, base)
    names = constant([t[0] for t in [*base, *templates]], "array<string>")
    of_base = F.filter("hits", lambda h: h["template"] < len(base))
    starts = F.transform(of_base, lambda h: h["start"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(names, h["template"])))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(of_base).alias("base_labels"), labels(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))


def op9_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op9_licenses` that SQL can express."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


OP9_PLACES_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache' WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label
  FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(s, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""
