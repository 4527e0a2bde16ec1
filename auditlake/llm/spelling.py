"""Grouping of spelling variants by an index of variable-length grams.

A word is padded at both ends, and a gram begins at each of its characters but the last: the shortest string of two
characters or more that is not frequent among the words' grams, or, where all are frequent, the longest allowed. The dictionary
grows level by level: only the places of frequent grams are counted again with one more character, so frequent grams are
pruned in favour of longer ones. Whether a gram is chosen depends on its own characters alone. So an edit changes just the
grams that cover it, and the most that any one place is covered by bounds how many of a word's grams an edit can affect.

The grams that an edit leaves alone are the same in both words, in the same order of rarity. With at most a affected grams, the first
of these is among the a + 1 rarest of either word. Only those lists are merged: words meet under (gram, place, length), where place and
length differ by one at most, and each pair that meets is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of

#: Code points a word has at least; also the most that a gram may have, so that an edit leaves one gram alone.
LEAST = 5
#: Occurrences a word has at least, and how many times as frequent as its variant a form is.
TIMES, RATIO = 3, 2
#: Places of a gram beyond which it is frequent.
FREQUENT = 64
#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: What stands before and after a word.
BEGIN, END = "\x02", "\x03"

RUN = re.compile("[a-zÀ-ÿ]+")
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs_of(text: str) -> Counter:
    """Maximal runs of letters of a text with A-Z lower-cased (and no other letter changed)."""
    return Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))


def misspelt(every: int):
    """A run as it is, or for each one in `every` of (document, run) without the code point that their checksum names."""

    def change(start: int, run: str) -> str:
        h = zlib.crc32(run.encode(), start)
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run

    return change


def counted(least: int, every: int | None):
    change = misspelt(every) if every else None

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for one, text in zip(b["id"].to_pylist(), b["text"], strict=True):
                start = zlib.crc32(f"{one}:".encode())
                for word, n in runs_of(text.as_py()).items():
                    if len(word) >= least:
                        word = change(start, word) if change else word
                        if len(word) >= least:
                            counts[word] += n
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    return run


def corpus_words(docs: DataFrame, least: int = LEAST, times: int = TIMES, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of `least` code points and `times` occurrences in all texts; with `every`, some of them misspelt on the way.

    Null texts have no words, and a null id counts as empty; repeated rows count each. Extra columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def variable_grams(words: DataFrame, longest: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """word, n, grams: array of (freq, gram, at), one for each place of the padded word."""
    padded = F.concat(F.lit(BEGIN), "word", F.lit(END))
    places = words.select("word", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at"))
    rows, done = places.withColumn("gram", F.substr("p", F.col("at"), F.lit(2))), []
    for size in range(2, longest + 1):
        rows = cut(rows)
        known = cut(rows.groupBy("gram").agg(F.count("*").alias("freq")))
        met = rows.hint("merge").join(known.hint("merge"), "gram")
        # At the end of its word a gram cannot grow.
        closed = (F.col("freq") <= frequent) | (F.col("at") + size > F.length("p")) | F.lit(size == longest)
        done.append(met.filter(closed).select("word", "freq", "gram", "at"))
        rows = met.filter(~closed).select("word", "p", "at", F.substr("p", F.col("at"), F.lit(size + 1)).alias("gram"))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    # A word's grams are no more than its characters.
    grams = every.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("freq", "gram", "at"))).alias("grams"))
    return words.hint("merge").join(grams.hint("merge"), "word")


def affected(grams: Column, length: Column, longest: int = LEAST) -> Column:
    """The most grams of a word that one edit can change: those that cover one of its characters."""
    sizes = F.transform(F.array_sort(F.transform(grams, lambda g: F.struct(g["at"].alias("at"), F.length(g["gram"]).alias("size")))), lambda g: g["size"])
    # Character e of the padded word (from 0) is covered by the gram at e - d if that has more than d characters.
    covering = lambda sizes, e: sum((F.when(F.get(sizes, e - d) > d, 1).otherwise(0) for d in range(longest)), F.lit(0))
    count = F.transform(F.array(sizes), lambda s: F.array_max(F.transform(F.sequence(F.lit(1), length), lambda e: covering(s, e))))
    return F.element_at(count, 1)


def near_pairs(words: DataFrame, longest: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """word, n, other, other_n: the words that differ by one inserted, deleted or replaced code point, each pair both ways. All words have `longest` code points at least."""
    decomposed = variable_grams(words, longest, frequent)
    rarest = F.slice("grams", 1, affected(F.col("grams"), F.length("word"), longest) + 1)
    index = cut(decomposed.select("word", "n", F.length("word").alias("size"), F.explode(rarest).alias("g")).select("word", "n", "size", "g.gram", "g.at"))
    # The other word is as long and has the gram at the same place, or is longer by one and has it there or one further on.
    step = lambda size, at: F.struct((F.col("size") + size).alias("size"), (F.col("at") + at).alias("at"))
    asked = index.select("gram", F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array(step(0, 0), step(1, 0), step(1, 1))).alias("x")).select("gram", "other", "other_n", "x.*")
    met = index.hint("merge").join(asked.hint("merge"), ["gram", "size", "at"]).filter((F.length("other") < F.col("size")) | (F.col("other") < F.col("word")))
    found = cut(met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct())
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms. Each round a root is replaced by its own root, so rounds are as many as the logarithm of the longest chain."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.hint("merge").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, longest: int = LEAST, frequent: int = FREQUENT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n).

    A word's form is its near word of largest n, ties to the smaller in the order of code points, if that n is at least `ratio` times
    its own. Its root is the last form that its forms lead to; n grows along them, so they end. Words are distinct, not null and
    have `longest` code points at least; no words give no rows. The result is the same for any value of `frequent`.
    """
    words = cut(words)
    best = F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best")
    near = near_pairs(words, longest, frequent).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.hint("merge").join(near.hint("merge"), "word", "left")
    enough = -F.col("best.down") >= ratio * F.col("n")
    found = cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.down")).alias("form_n"),
    ))
    roots = last_forms(found.filter("form IS NOT NULL"))
    return found.hint("merge").join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(read(spark, sf_dir, "documents"), every=97))


#: `t` is the table of the checksum: each byte, eight times halved and, if it was odd, mixed with the polynomial.
OP11_SQL = """
WITH RECURSIVE
b AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5),
crc AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM hexed, t),
said AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
v AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS d FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS k)),
one AS (SELECT DISTINCT v.word, v.n, w.word AS other, w.n AS other_n FROM v JOIN w ON v.d = w.word),
near AS (
  SELECT * FROM one UNION SELECT other, other_n, word, n FROM one
  UNION SELECT x.word, x.n, y.word, y.n FROM v x JOIN v y ON x.d = y.d AND x.k = y.k AND x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""
