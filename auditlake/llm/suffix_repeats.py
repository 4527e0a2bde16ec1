"""Removal of long repeated byte strings by the common-prefix interval trees of sparse enhanced suffix arrays.

A string of `length` bytes has an anchor: the leftmost of its `gram`-byte substrings with the smallest hash. Equal
strings have it at the same place, so only suffixes that begin at anchors are sorted, one of every hundred bytes
or so. An anchor's context is what any string with that anchor can cover: `length - gram` bytes to its left and
`length` bytes from it on. Counts by (gram, context) come first: equal contexts are one from then on, a gram with a single
place leaves, and texts meet only the contexts that must be compared.

Suffixes with one gram are an enhanced suffix array: sorted, with the common prefixes of neighbours. A stack scan
of it visits the common-prefix intervals from the deepest up. Where intervals join, the members' left extensions are
tested: kept in order of their reversed left contexts, only those next to each other across the joined
intervals can share more to the left than before. Two suffixes that share L bytes to the left and R to the right
occur in a repeat of L + R bytes, and all occurrences get the widest of theirs, not just neighbours in the array.

A gram with more contexts than one task should hold leaves the tree: its contexts are counted by what they share, first in a few
slices of the possible offsets and then, where a slice is shared, string by string. That is exact for any value of `most`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of

LENGTH, GRAM = 400, 200
#: Contexts of one gram that a task compares in a tree at most; more are counted string by string.
MOST = 20_000
#: Slices of offsets in which the contexts of such a gram are counted first.
SLICES = 8
#: Bytes that are hashed at a time, and that a batch of rows holds about.
PIECE, BATCH = 1 << 20, 8 << 20
#: Identities of texts (16 bytes each) that are sent to every executor at most; beyond, all texts go through the shuffle.
BROADCAST_ROWS = 1_000_000


class Hashes:
    """Rolling hashes of all substrings of `gram` bytes, modulo 2**64, of up to `size` bytes at a time."""

    def __init__(self, gram: int, size: int):
        rng = np.random.default_rng(400)
        self.gram, self.values = gram, rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 60)) * 8 + 5
        self.powers, self.inverse = self.series(base, size), self.series(pow(base, -1, 1 << 64), size)

    @staticmethod
    def series(base: int, size: int) -> np.ndarray:
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h


def least_places(h: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each window of `width` hashes, the place of its smallest (the leftmost of equal ones): minima of blocks from both sides.

    A hash gives its lowest `bits` to its place. Their number is fixed, so that equal strings choose alike in any buffer.
    """
    n, low = len(h), np.uint64(bits)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = (h >> low << low) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of a text, offset, bytes), PIECE bytes or so at a time; the pieces of a long text share length - 1 bytes, so that each string lies in one."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, PIECE):
            part = text[begin : begin + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield held
                held, size = [], 0
            held.append((number, begin, part))
            size += len(part)
    if held:
        yield held


def anchors(texts: list[bytes], hashes: Hashes, length: int) -> list[tuple[list[int], list[int]]]:
    """Places and hashes of the anchors of all strings of `length` bytes in each text."""
    found: list[dict[int, int]] = [{} for _ in texts]
    for parts in pieces(texts, length):
        sizes = np.array([len(x) for _, _, x in parts])
        ends = np.cumsum(sizes)
        h = hashes.of(np.frombuffer(b"".join(x for _, _, x in parts), dtype=np.uint8))
        least = least_places(h, length - hashes.gram + 1, (PIECE + length).bit_length())
        inside = np.arange(len(least)) + length <= np.repeat(ends, sizes)[: len(least)]
        marked = np.zeros(len(h), dtype=bool)
        marked[least[inside]] = True
        at = np.flatnonzero(marked)
        part = np.searchsorted(ends, at, side="right")
        cuts = np.searchsorted(part, np.arange(len(parts) + 1))
        names = h[at].view(np.int64)
        for k, (number, begin, _) in enumerate(parts):
            here = slice(cuts[k], cuts[k + 1])
            found[number].update(zip((at[here] - (ends[k] - sizes[k]) + begin).tolist(), names[here].tolist(), strict=True))
    return [(list(x), list(x.values())) for x in found]


def sides(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    """An anchor's context: the bytes to its left, and those from it on."""
    return text[max(0, at - length + gram) : at], text[at : at + length]


def name_of(left: bytes, right: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(len(left).to_bytes(4, "big") + left + right, digest_size=8).digest(), "big", signed=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, list)))
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


ANCHORED = pa.schema([("tid", pa.binary()), ("at", pa.list_(pa.int32())), ("g", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])


def anchored(length: int, gram: int):
    """tid, and at, g, c of its anchors, once for each text of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes, seen = Hashes(gram, PIECE + length), set()
        for b in batches:
            held = {tid: body.as_py() for tid, body in zip(b["tid"].to_pylist(), b["body"], strict=True) if tid not in seen}
            seen.update(held)
            for (tid, text), (at, g) in zip(held.items(), anchors(list(held.values()), hashes, length), strict=True):
                yield tid, at, g, [name_of(*sides(text, p, length, gram)) for p in at]

    return lambda batches: in_batches(rows(batches), ANCHORED)


CONTEXTS = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])


def with_texts(use, schema: pa.Schema):
    """Rows of (tid, body or null, list or null), each tid's list first and then its text, however often: use(tid, text, list) once for each tid that has both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tid, asked = None, None
        for b in batches:
            for i in range(b.num_rows):
                x = b["tid"][i].as_py()
                if x != tid:
                    tid, asked = x, None
                if b["body"][i].is_valid:
                    if asked is not None:
                        yield from use(tid, b["body"][i].as_py(), asked)
                        asked = None
                else:
                    asked = b["asked"][i].as_py()

    return lambda batches: in_batches(rows(batches), schema)


def lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices compare faster than single bytes."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def widest(contexts: list[tuple[bytes, bytes, int]], length: int) -> list[tuple[int, int]]:
    """For each (left, right, copies) with one gram: the most bytes to its left and to its right that lie in strings of `length` bytes it shares with another.

    The suffix array of the right sides is scanned with a stack of common-prefix intervals. Each keeps its members in the order of
    their reversed left sides. When two join, at the depth of their common prefix, a member of the smaller one can share
    more to the left only with the members next to it; what it shares with others is no more at no greater depth.
    """
    n = len(contexts)
    best = [(len(x[0]), len(x[1])) if x[2] > 1 and len(x[0]) + len(x[1]) >= length else (0, 0) for x in contexts]
    lefts = [x[0][::-1] for x in contexts]
    order = sorted(range(n), key=lambda i: (contexts[i][1], lefts[i]))
    rank = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (lefts[i], i)))}
    of_rank = [0] * n
    for i, k in rank.items():
        of_rank[k] = i

    def tell(i: int, j: int, depth: int) -> None:
        shared = lcp(lefts[i], lefts[j])
        if shared + depth >= length:
            for x in (i, j):
                best[x] = (max(best[x][0], shared), max(best[x][1], depth))

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        for k in small:
            place = bisect_left(large, k)
            if place:
                tell(of_rank[k], of_rank[large[place - 1]], depth)
            if place < len(large):
                tell(of_rank[k], of_rank[large[place]], depth)
            insort(large, k)
        return large

    stack: list[tuple[int, list[int]]] = []  # open intervals: depth of the common prefix with what came before, members
    for place, i in enumerate(order):
        depth = lcp(contexts[order[place - 1]][1], contexts[i][1]) if place else 0
        members = stack.pop()[1] if stack else None
        # Deeper intervals end here: they join their parents, the deepest first.
        while stack and stack[-1][0] > depth:
            above, others = stack.pop()
            members = join(others, members, above)
        if members is not None:
            stack.append((depth, members))
        stack.append((1 << 60, [rank[i]]))
    members = stack.pop()[1] if stack else None
    while stack:
        above, others = stack.pop()
        members = join(others, members, above)
    return best


WIDTHS = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("back", pa.int32()), ("ahead", pa.int32())])


def grown(length: int):
    """g, c, back, ahead of contexts that share a string of `length` bytes; rows arrive sorted by g and hold one gram in memory at a time."""

    def group(g: int, held: list[tuple]) -> Iterator[tuple]:
        for (c, *_), (back, ahead) in zip(held, widest([x[1:] for x in held], length), strict=True):
            if back + ahead:
                yield g, c, back, ahead

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, held = None, []
        for b in batches:
            for g, c, n, left, right in zip(*(b[x].to_pylist() for x in ("g", "c", "n", "left", "right")), strict=True):
                if g != last and held:
                    yield from group(last, held)
                    held = []
                last = g
                held.append((c, left, right, n))
        if held:
            yield from group(last, held)

    return lambda batches: in_batches(rows(batches), WIDTHS)


def slices_of(length: int, gram: int) -> list[tuple[int, int]]:
    """The offsets 0 to length - gram of an anchor in a string, in SLICES runs: first and last of each."""
    step = -(-(length - gram + 1) // SLICES)
    return [(o, min(o + step - 1, length - gram)) for o in range(0, length - gram + 1, step)]


SLICED = pa.schema([("k", pa.binary()), ("slice", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])
STRINGS = pa.schema([("k", pa.binary()), ("g", pa.int64()), ("c", pa.int64()), ("offset", pa.int32()), ("n", pa.int64())])


def sliced(length: int, gram: int):
    """What all strings of a slice of offsets share, hashed: the bytes of its first offset to the left, and to the right what its last one leaves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for g, c, n, left, right in zip(*(b[x].to_pylist() for x in ("g", "c", "n", "left", "right")), strict=True):
                for k, (first, last) in enumerate(slices_of(length, gram)):
                    if first <= len(left) and length - last <= len(right):
                        yield hashlib.blake2b(bytes([k]) + left[len(left) - first :] + right[: length - last], digest_size=16).digest(), k, g, c, n

    return lambda batches: in_batches(rows(batches), SLICED)


def strings(length: int, gram: int):
    """Every string of `length` bytes of the slices asked for, hashed with its offset before the anchor: a string that holds two anchors is one of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        runs = slices_of(length, gram)
        for b in batches:
            for g, c, n, left, right, asked in zip(*(b[x].to_pylist() for x in ("g", "c", "n", "left", "right", "slices")), strict=True):
                whole = left + right
                for k in asked:
                    for offset in range(runs[k][0], runs[k][1] + 1):
                        begin = len(left) - offset
                        if begin >= 0 and begin + length <= len(whole):
                            yield hashlib.blake2b(offset.to_bytes(4, "big") + whole[begin : begin + length], digest_size=16).digest(), g, c, offset, n

    return lambda batches: in_batches(rows(batches), STRINGS)


def ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def counted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same as `grown` without a tree, for grams of any number of contexts: counts by hash, combined before each shuffle."""
    contexts = cut(contexts)
    keys = cut(contexts.mapInArrow(sliced(length, gram), ddl(SLICED)))
    shared = cut(keys.groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").select("k"))
    asked = keys.hint("merge").join(shared.hint("merge"), "k").groupBy("g", "c").agg(F.collect_set("slice").alias("slices"))  # SLICES at most
    chosen = contexts.hint("merge").join(asked.hint("merge"), ["g", "c"])
    rows = cut(chosen.mapInArrow(strings(length, gram), ddl(STRINGS)))
    repeated = cut(rows.groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").select("k"))
    met = rows.hint("merge").join(repeated.hint("merge"), "k").groupBy("g", "c")
    return met.agg(F.max("offset").alias("back"), (F.lit(length) - F.min("offset")).cast("int").alias("ahead"))


def bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tid (the first 16 bytes of the text's SHA-256), body (UTF-8), n_bytes."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("body"), F.sha2(text, 256).alias("sha"))
    return rows.select("doc_id", F.unhex(F.substring("sha", 1, 32)).alias("tid"), "body", F.octet_length("body").cast("long").alias("n_bytes"), "sha")


def meet(texts: DataFrame, lists: DataFrame, use, schema: pa.Schema) -> DataFrame:
    """`use` of each text that has a list. Texts and lists meet by one shuffle on the text's identity; texts without a list stay behind while the identities can be sent."""
    lists = cut(lists)
    ids = lists.select("tid")
    if ids.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "tid", "left_semi")
    kind = dict(lists.dtypes)["asked"]
    both = texts.select("tid", "body", F.lit(None).cast(kind).alias("asked")).unionByName(lists.select("tid", F.lit(None).cast("binary").alias("body"), "asked"))
    return both.repartition("tid").sortWithinPartitions("tid", F.col("body").isNotNull()).mapInArrow(with_texts(use, schema), ddl(schema))


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """tid, at, back, ahead, g, c: the anchors of distinct texts in repeated strings of `length` bytes, and how far those reach before and from the anchor.

    Occurrences of one maximal repeat around an anchor have one (g, c) where their contexts are equal. Rows of `texts` (tid, body) may repeat.
    """
    long = texts.filter(F.octet_length("body") >= length)
    lists = cut(long.mapInArrow(anchored(length, gram), ddl(ANCHORED)).groupBy("tid").agg(*[F.any_value(x).alias(x) for x in ("at", "g", "c")]))
    grams = cut(lists.select(F.explode("g").alias("g")).groupBy("g").count().filter("count > 1").select("g"))
    all_places = lists.select("tid", F.explode(F.arrays_zip("at", "g", "c")).alias("x")).select("tid", "x.*")
    places = cut(all_places.hint("merge").join(grams.hint("merge"), "g"))
    kinds = cut(places.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("place")))
    # Grams of more contexts than `most` are sent, one for every `most` rows at most: the rows of a gram need not meet to be told.
    many = kinds.groupBy("g").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > most).select("g", F.lit(True).alias("hot"))
    repeated = kinds.join(F.broadcast(many), "g", "left")
    asked = F.struct(F.col("place.at").alias("at"), "g", "c", "n", F.coalesce("hot", F.lit(False)).alias("hot"))

    def contexts(_tid: bytes, text: bytes, chosen: list[dict]) -> Iterator[tuple]:
        for x in chosen:
            yield (x["g"], x["c"], x["n"], x["hot"], *sides(text, x["at"], length, gram))

    # A text's distinct contexts are no more than its bytes, which are one row already.
    chosen = repeated.groupBy(F.col("place.tid").alias("tid")).agg(F.collect_list(asked).alias("asked"))
    found = cut(meet(long, chosen, contexts, CONTEXTS))
    widths = found.filter("NOT hot").repartition("g").sortWithinPartitions("g").mapInArrow(grown(length), ddl(WIDTHS))
    hot = found.filter("hot")
    if not hot.isEmpty():
        widths = widths.unionByName(counted(hot, length, gram))
    return places.hint("merge").join(cut(widths).hint("merge"), ["g", "c"]).select("tid", "at", "back", "ahead", "g", "c")


KEPT = pa.schema([("tid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def without(tid: bytes, text: bytes, spans: list[dict]) -> Iterator[tuple]:
    kept, end, removed, runs = [], 0, 0, 0
    stop = -1
    for x in sorted(spans, key=lambda x: (x["start"], x["stop"])):
        if x["start"] > stop:
            kept.append(text[max(end, 0) : x["start"]])
            runs += 1
            removed += x["stop"] - x["start"]
        elif x["stop"] > stop:
            removed += x["stop"] - stop
        stop = end = max(stop, x["stop"])
    kept.append(text[end:])
    yield tid, removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where nothing was removed).

    Bytes covered by a string of `length` bytes that also starts anywhere else, in this or another document or in this one again
    with an overlap, are removed. A null text counts as empty and keeps nothing; rows that repeat an id are documents of their
    own, so a repeated row of `length` bytes or more is removed whole. Texts shorter than `length` stay. An empty table gives an empty
    one. Other columns of `docs` are not read, whatever their names.
    """
    rows = bodies(docs, id_col, text_col)
    small = cut(rows.select("doc_id", "tid", "n_bytes", "sha"))
    copied = F.col("copies") > 1
    texts = small.filter(F.col("n_bytes") >= length).groupBy("tid").agg(F.count("*").alias("copies"), F.first("n_bytes").cast("int").alias("n_bytes"))
    span = F.struct((F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("ahead")).alias("stop"))
    lists = repeats(rows.select("tid", "body"), length, gram, most).groupBy("tid").agg(F.collect_list(span).alias("spans"))
    known = cut(texts.hint("merge").join(lists.hint("merge"), "tid", "left"))
    # A text that occurs twice is repeated whole; only the others are read again.
    part = known.filter(~copied & F.col("spans").isNotNull()).select("tid", F.col("spans").alias("asked"))
    done = cut(meet(rows.select("tid", "body"), part, without, KEPT))
    whole = known.filter(copied).select("tid", F.col("n_bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    results = done.unionByName(whole).withColumn("kept_sha", F.sha2("kept", 256))
    none = F.lit(0).cast("long")
    joined = small.hint("merge").join(results.hint("merge"), "tid", "left")
    removed, spans, sha = (F.coalesce(F.col(a), b).alias(c) for a, b, c in (("n_removed", none, "n_removed"), ("n_spans", none, "n_spans"), ("kept_sha", F.col("sha"), "kept_sha256")))
    return joined.select("doc_id", "n_bytes", removed, spans, sha, "kept")


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


#: Strings in hexadecimal, two characters a byte. A string begins at byte i (from 0); its bytes are covered if its hash is another one's.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, len(h) // 2 - 399)) AS i, unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: md5_number(substr(h, 2 * i + 1, 800)))) AS m FROM d WHERE len(h) >= 800),
c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s SEMI JOIN (SELECT m FROM s GROUP BY m HAVING count(*) > 1) USING (m)),
k AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM c),
p AS (SELECT r, run, min(i) AS b, max(i) + 400 AS e FROM k GROUP BY r, run),
q AS (SELECT p.r, run, e - b AS n, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY p.r ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY p.r ORDER BY b), 0))) AS kept, CASE WHEN lead(b) OVER (PARTITION BY p.r ORDER BY b) IS NULL THEN substr(h, 2 * e + 1) ELSE '' END AS rest FROM p JOIN d USING (r)),
f AS (SELECT r, sum(n)::BIGINT AS n_removed, count(*) AS n_spans, sha256(unhex(string_agg(kept || rest, '' ORDER BY run))) AS sha FROM q GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(unhex(h))) AS kept_sha256 FROM d LEFT JOIN f USING (r)
"""
