"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes a and b with a similarity of num / den or more differ in at most
H = (a + b) * (den - num) / (den + num) shingles. The universe is hashed into segments; a size band (sizes
4^k to 4^(k+1)) has a partition of its own, and a pair is found in that of its smaller set. A set's exact subsets are
indexed segment by segment, then, if those are too few, its subsets less one shingle, again segment by segment. An
exact subset is one unit; a segment of two shingles or more whose one-deletion neighbourhood is indexed too is two. A
set stops once it has its allotment: more units than H with its largest partner, and some in reserve. One difference
costs at most one unit, and both sets of a pair index the segments that come first, so in what the one that stops
earlier has indexed, it shares a signature with every set it is similar to (pigeonhole). A unit costs one posting by
an exact subset, and one for each of a segment's shingles by its neighbourhood; so exact subsets are used first, and
`segments_of` chooses the longest segments with which a set of a band's largest size has its allotment of them on average.

A signature that many sets share is worth nothing (all its holders see that alike). Sets that keep enough units without
those are found by their other signatures; pairs are then counted, since similar sets share many, and verified on
their shingles. Sets left with too few units can only be missed with each other, and then under a signature of many
holders that both have: they are compared with one leader per signature first, and then exhaustively where one
signature still joins several components. So COMMON decides which way a link is found, and never whether. Of these sets
only those are compared of which other ones hold so much together that they can be similar to one.

Identical sets are one node throughout, so copies are never paired. Shingles are hashes of 64 bits, whose words are
hashed by a random number for each byte at each place; sets have an identity of 63 bits and a check of 64 more, and
sets that share an identity but not the check are compared with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shuffles_released

NUM, DEN, SHINGLE = 3, 4, 5
#: A signature with more holders than this is worth no unit.
COMMON = 24
#: Shingles that a tile compares at a time.
COLUMNS = 4096
#: Shingles of a tile of sets, and of a block, which is a task's; as many blocks of a cluster as that allows, and what a set counts besides its shingles.
TILE, BLOCK, BLOCKS, ROW = 40_000, 1_000_000, 8, 32
#: Sets that a task remembers so as not to sign copies again.
SETS_HELD = 400_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def drawn(places: np.ndarray) -> np.ndarray:
    """The random number of a byte at a place of its word (place * 256 + byte)."""
    return mixed(mixed((places.astype(np.uint64) + np.uint64(1)) * BASE) + M2)


#: ASCII white space as 0, every other byte as 1.
BLANKS = bytes(0 if b in b" \t\n\x0b\x0c\r" else 1 for b in range(256))
#: The numbers of the first places, and what the words of a shingle are multiplied by.
DRAWN, PLACES = drawn(np.arange(64 << 8)), mixed(np.arange(301, 301 + SHINGLE, dtype=np.uint64) * BASE) | np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, of the whole sequence; of none, nothing."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    kinds = np.frombuffer(b"\0" + raw.translate(BLANKS) + b"\0", np.uint8)
    edges = np.flatnonzero(kinds[1:] != kinds[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    begin, end = edges[0], edges[-1]
    runs = np.diff(edges)
    longest = runs.max()
    at = np.arange(begin, end, dtype=np.int32 if longest <= 64 and end < 1 << 31 else np.int64)
    at -= np.repeat(edges[:-1].astype(at.dtype), runs)
    at <<= 8
    at |= np.frombuffer(raw, np.uint8)[begin:end]
    terms = DRAWN.take(at) if longest <= 64 else drawn(at)
    h = mixed(np.add.reduceat(terms, edges[:-1] - begin)[::2] + runs[::2].astype(np.uint64) * M2)
    size = min(k, len(h))
    n = len(h) - size + 1
    total = h[:n] * PLACES[0]
    for i in range(1, size):
        total += h[i : n + i] * PLACES[i]
    total = mixed(total + np.uint64(size))
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def node_of(tokens: np.ndarray) -> int:
    """Identity of a set, 63 bits: the lowest is free for a mark."""
    total = np.add.reduce(tokens, keepdims=True) + np.array([len(tokens)], np.uint64) * M1
    return int(mixed(total).view(np.int64)[0]) & ~1


def check_of(tokens: np.ndarray) -> int:
    """Another 64 bits of a set's identity."""
    return int(np.add.reduce(mixed(tokens ^ BASE), keepdims=True).view(np.int64)[0])


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of similar sets of sizes a and b."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def bands(size: int) -> list[int]:
    """A set's own band, and the one below if that has similar sizes."""
    own = (size.bit_length() - 1) // 2
    return [own] + ([own - 1] if own and NUM * size <= DEN * (4**own - 1) else [])


def need(size: int, band: int) -> int:
    """Units that a set must exceed in a band's partition, whichever similar partner it has there."""
    return most_apart(size, size * DEN // NUM if size < 4 ** (band + 1) else 4 ** (band + 1) - 1)


def allotment(size: int, band: int) -> int:
    """Units that a set takes: what it needs, and a reserve for signatures that turn out to be common."""
    least = need(size, band) + 1
    return least + least // 8 + 3


@lru_cache(maxsize=None)
def segments_of(band: int) -> int:
    """Segments of a band's partition: as few as give a set of the largest size its allotment of exact subsets on average."""
    top = 4 ** (band + 1) - 1
    wanted, m = min(allotment(top, band), 0.8 * top), 1
    while m * (1 - math.exp(-top / m)) < wanted:
        m += max(1, m // 256)
    return m


def partition(tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order of their segments (multiplied by the band's own number), segment of each, and starts and sizes of the segments."""
    h = tokens * (M1 + np.uint64(2 * band))
    h.sort()
    seg = ((h >> np.uint64(40)) * np.uint64(segments_of(band))) >> np.uint64(24)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return h, seg, starts, np.diff(np.append(starts, len(seg)))


def worth(tokens: np.ndarray, band: int) -> tuple[int, int]:
    """Exact subsets that a set indexes in a band's partition, and its units with the deletions."""
    m = np.uint64(segments_of(band))
    counts = np.bincount((((tokens * (M1 + np.uint64(2 * band))) >> np.uint64(40)) * m >> np.uint64(24)).astype(np.int64))
    wanted = allotment(len(tokens), band)
    exact = min(wanted, int(np.count_nonzero(counts)))
    return exact, min(wanted, exact + int(np.count_nonzero(counts > 1)))


def signatures(tokens: np.ndarray, band: int) -> np.ndarray:
    """Hashes of the indexed subsets of a set, up to its allotment: of whole segments, then of segments less one shingle."""
    h, seg, starts, counts = partition(tokens, band)
    wanted = allotment(len(tokens), band)
    seeded = np.add.reduceat(h, starts) + (seg[starts] * np.uint64(64) + np.uint64(band + 1)) * M2
    exact = mixed(seeded[:wanted])
    if len(starts) >= wanted:
        return exact
    some = np.flatnonzero(counts > 1)[: wanted - len(starts)]
    which = np.repeat(np.isin(np.arange(len(starts)), some), counts)
    return np.concatenate((exact, mixed(np.repeat(seeded, counts)[which] - h[which])))


INFO = "_key long, doc_id long, node long, check long, n long, band int, segments int, units int, low_segments int, low_units int"


def informer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its node and check, set size, and what it indexes in its own band and the one below (else -1)."""
    for b in batches:
        rows = []
        for key, doc_id, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], strict=True):
            t = shingles(text.as_py())
            if len(t):
                own, *low = bands(len(t))
                rows.append((key, doc_id, node_of(t), check_of(t), len(t), own, *worth(t, own), *(worth(t, low[0]) if low else (-1, -1))))
            else:
                rows.append((key, doc_id, None, None, 0, None, None, None, None, None))
        if rows:
            types = (*[pa.int64()] * 5, *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in INFO.split(", ")])


def signer(common: int):
    """sig, node, hot of each document's signatures; the lowest bit of `node` marks its own band. A task's repeated sets go once.

    A signature that more than `common` sets have in what a task sends at a time goes so often as shows it, and all
    its holders go apart, marked as `hot`: they need not meet in one task.
    """

    def sent(sigs: list, nodes: list) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        s, n = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(s, kind="stable")
        inside = s[order]
        starts = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1])))
        lengths = np.diff(np.append(starts, len(s)))
        # In the order of the sets, which a shuffle packs better.
        many, shown = np.zeros(len(s), bool), np.ones(len(s), bool)
        many[order] = np.repeat(lengths > common, lengths)
        shown[order] = np.arange(len(s)) - np.repeat(starts, lengths) <= common
        hot = np.concatenate((np.zeros(shown.sum(), bool), np.ones(many.sum(), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((s[shown], s[many])).view(np.int64)), pa.array(np.concatenate((n[shown], n[many]))), pa.array(hot)], names=["sig", "node", "hot"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        sigs, nodes, held = [], [], 0
        for b in batches:
            for text in b[0]:
                t = shingles(text.as_py())
                if not len(t) or (node := node_of(t)) in seen:
                    continue
                seen.add(node)
                for i, band in enumerate(bands(len(t))):
                    s = signatures(t, band)
                    sigs.append(s)
                    nodes.append(np.full(len(s), node | (i == 0), np.int64))
                    held += len(s)
                if held > 500_000:
                    yield from sent(sigs, nodes)
                    sigs, nodes, held = [], [], 0
                    if len(seen) > SETS_HELD:
                        seen.clear()
        yield from sent(sigs, nodes)

    return sign


def runs(common: int):
    """Of rows sorted by sig: pairs of holders (a, b, null) of each signature with few holders, (null, node, sig) of the others and of what is marked hot.

    Only the run at hand is kept, and of a long one only that it is long; a long run's holders can come repeated.
    """

    def pairs(s: np.ndarray, n: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
        """a and b of the pairs in whole runs; sig and node of the rows in long ones."""
        none = np.empty(0, np.int64)
        if not len(s):
            return [], [], none, none
        new = np.concatenate(([True], s[1:] != s[:-1]))
        single = new & np.concatenate((new[1:], [True]))
        s, n = s[~single], n[~single]
        order = np.lexsort((n, s))
        s, n = s[order], n[order]
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (n[1:] != n[:-1]))) if len(s) else none.astype(bool)
        s, n = s[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else none
        lengths = np.diff(np.append(starts, len(s)))
        many = np.repeat(lengths > common, lengths)
        s2, n2, left, right = s[~many], n[~many], [], []
        for d in range(1, common):
            same = s2[d:] == s2[:-d]
            if not same.any():
                break
            a, b = n2[:-d][same], n2[d:][same]
            own = ((a | b) & 1) == 1
            left.append(a[own] & ~1)
            right.append(b[own] & ~1)
        return left, right, s[many], n[many]

    def out(left: list, right: list, sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if len(a) + len(node):
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), none(len(node))]), pa.concat_arrays([pa.array(b), pa.array(node)]), pa.concat_arrays([none(len(a)), pa.array(sig)])], names=["a", "b", "sig"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node, long_sig = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            s, n, hot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield from out([], [], s[hot], n[hot])
            s, n = s[~hot], n[~hot]
            if not len(s):
                continue
            if long_sig is not None:
                more = s == long_sig  # at the front, if any
                yield from out([], [], s[more], n[more])
                s, n = s[~more], n[~more]
                if not len(s):
                    continue
                long_sig = None
            sig, node = np.concatenate((sig, s)), np.concatenate((node, n))
            last = len(sig) - int((sig == sig[-1]).sum())
            yield from out(*pairs(sig[:last], node[:last]))
            holders = np.unique(node[last:])
            if len(holders) > common:
                long_sig = sig[-1]
                yield from out([], [], np.full(len(holders), long_sig), holders)
                sig, node = sig[:0], node[:0]
            else:
                sig, node = np.full(len(holders), sig[-1]), holders
        yield from out(*pairs(sig, node))

    return found


def tokeniser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the set's shingles."""
    for b in batches:
        nodes, sets, held = [], [], 0
        for node, text in zip(b[0].to_pylist(), b[1], strict=True):
            t = shingles(text.as_py())
            nodes.append(node)
            sets.append(t.view(np.int64))
            held += len(t)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])
                nodes, sets, held = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])


def components(edges: DataFrame) -> DataFrame:
    """node, root of the connected components of edges (a, b), by randomised contraction.

    A round contracts each node into the first of itself and its neighbours; every second round draws the order of the
    nodes anew, so those that are left shrink by a constant factor on average, whatever the shape: paths too take a
    logarithm of rounds. Two rounds by one order end a star, whose middle is the first of its nodes after the first.
    The tables of a round are written out and read back, so Spark knows their size and sends them to all tasks only
    below its threshold.
    """
    maps, rest = [], edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        rest = cut(rest)
        if rest.isEmpty():
            break
        drawn_ = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps) // 2)).alias("draw"), F.col(c).alias("node"))  # noqa: B023, E731
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        maps.append(cut(both.groupBy("a").agg(F.min(drawn_("b")).alias("first")).select(F.col("a").alias("node"), F.least("first", drawn_("a")).getField("node").alias("root"))))
        x, y = (maps[-1].select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
        rest = rest.join(x, "a").join(y, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    if not maps:
        return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0))
    whole = maps[-1]
    for step in maps[-2::-1]:
        whole = cut(step.join(whole.select(F.col("node").alias("root"), F.col("root").alias("_above")), "root", "left").select("node", F.coalesce("_above", "root").alias("root")))
    return whole


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`roots` after further edges, found on the components that these join."""
    x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
    up = cut(edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct())
    if up.isEmpty():
        return roots
    top = components(up)
    above = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("_above")), "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
    return cut(above.unionByName(top.join(roots.select("node"), "node", "left_anti")))


def sets_of(nodes: DataFrame, docs: DataFrame, info: DataFrame) -> DataFrame:
    """node, tokens of the asked nodes (distinct `node`), from one document of each."""
    first = info.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("_key", "doc_id")).alias("row"))
    keys = first.hint("merge").join(nodes.hint("merge"), "node").select("node", F.col("row._key").alias("_key"), F.col("row.doc_id").alias("_id"))
    # The hash alone would take a wrong text for a handful of 10^10 rows.
    same = (docs["_key"] == keys["_key"]) & docs["doc_id"].eqNullSafe(keys["_id"])
    texts = docs.select("_key", "doc_id", "text").hint("merge").join(keys.hint("merge"), same).select("node", "text")
    return texts.mapInArrow(tokeniser, "node long, tokens array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their shingles."""
    x, y = (sets.select(F.col("node").alias(c), F.col("tokens").alias(t)).hint("merge") for c, t in (("a", "ta"), ("b", "tb")))
    shared, union = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
    return cut(pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").filter(shared * (DEN + NUM) >= union * NUM).select("a", "b"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(_key, doc_id, node, n of each row; node, root of the nodes that have links)."""
    with shuffles_released(docs.sparkSession):
        return linked_sets(docs, id_col, text_col, common)


def linked_sets(docs: DataFrame, id_col: str, text_col: str, common: int) -> tuple[DataFrame, DataFrame]:
    """What `linked` returns, as tables that are written out."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text")))
    info, doubled = told_apart(cut(docs.select("_key", "doc_id", "text").mapInArrow(informer, INFO)))

    # Nodes by partition: n, exact subsets, units and the units to exceed.
    nodes = info.filter("node IS NOT NULL").dropDuplicates(["node"])
    own = nodes.select("node", "n", F.lit(1).alias("own"), "band", "segments", "units")
    low = nodes.filter("low_units >= 0").select("node", "n", F.lit(0).alias("own"), (F.col("band") - 1).alias("band"), F.col("low_segments").alias("segments"), F.col("low_units").alias("units"))
    other = F.when(F.col("own") == 1, F.floor(F.col("n") * DEN / NUM)).otherwise(F.pow(F.lit(4), F.col("band") + 1).cast("long") - 1)
    schemes = own.unionByName(low).withColumn("need", F.floor((F.col("n") + other) * (DEN - NUM) / (DEN + NUM)))

    signed = docs.select("text").mapInArrow(signer(common), "sig long, node long, hot boolean")
    dealt = signed.repartition(F.when(F.col("hot"), F.xxhash64("sig", "node")).otherwise(F.col("sig")))
    met = cut(dealt.sortWithinPartitions("sig").mapInArrow(runs(common), "a long, b long, sig long"))
    hot = met.filter("sig IS NOT NULL").select("sig", F.col("b").bitwiseAND(-2).alias("node"), F.col("b").bitwiseAND(1).cast("int").alias("own")).distinct()
    lost = hot.groupBy("node", "own").agg(F.count("*").alias("hot"))
    schemes = cut(schemes.hint("merge").join(lost.hint("merge"), ["node", "own"], "left").na.fill(0, ["hot"]))

    # Sets with too few units left can be missed with each other alone.
    worth_each = F.when(F.col("units") > F.col("segments"), 2).otherwise(1)
    is_few = (F.col("units") - worth_each * F.col("hot") <= F.col("need")) & (F.col("hot") > 0)
    few = schemes.filter(is_few).select("node", "own")

    # Pairs that share enough signatures for similar sets, in the partition of the smaller set, where both can have those of many holders too.
    counted = met.filter("sig IS NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"))
    sides = []
    for c in ("a", "b"):
        left = lambda of: F.max(F.when(F.col("own") == of, F.struct("units", "hot", is_few.alias("few"))))
        got = schemes.groupBy(F.col("node").alias(c)).agg(F.first("n").alias(f"n_{c}"), F.max(F.when(F.col("own") == 1, F.col("band"))).alias(f"band_{c}"), left(1).alias(f"own_{c}"), left(0).alias(f"low_{c}"))
        sides.append(got.hint("merge"))
    scheme = F.least("band_a", "band_b")
    apart = F.floor((F.col("n_a") + F.col("n_b")) * (DEN - NUM) / (DEN + NUM))
    of = lambda c, name, none: F.coalesce(F.when(F.col(f"band_{c}") == scheme, F.col(f"own_{c}")[name]).otherwise(F.col(f"low_{c}")[name]), F.lit(none))
    units, common_ = (F.least(of("a", name, 0), of("b", name, 0)) for name in ("units", "hot"))
    # Two sets with too few units left that share a signature of many holders are compared with those; without one, they share the more others.
    must = ~(of("a", "few", False) & of("b", "few", False)) | (F.col("shared") >= units - apart)
    likely = cut(
        counted.hint("merge").join(sides[0], "a").hint("merge").join(sides[1], "b")
        .filter((F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM) & (F.col("shared") >= F.greatest(F.lit(1), units - common_ - apart)))
        .select("a", "b", "shared", must.alias("must"))
    )

    hard = cut(hot.hint("merge").join(few.hint("merge"), ["node", "own"]).select("sig", "node", "own"))
    asked = likely.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hard.select("node")).distinct()
    sets = cut(sets_of(asked, docs, info))
    roots = among_likely(likely, sets)
    if not hard.isEmpty():
        roots = among_hard(hard, roots, sets)
    lacking = cut(schemes.filter("units <= need").select("node").unionByName(doubled).distinct())
    if not lacking.isEmpty():
        roots = merged(roots, against_all(lacking, docs, info))
    return info.select("_key", "doc_id", "node", "n"), roots


def told_apart(info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`info` in which different sets have different nodes, and the nodes of those that had one together (of 10^9 sets hardly any).

    The index knows such sets by their old node alone; they leave it, and are compared with all others.
    """
    one = info.filter("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    several = cut(one.filter("low <> high").select("node"))
    if several.isEmpty():
        return info, several
    marked = info.hint("merge").join(several.withColumn("_several", F.lit(True)).hint("merge"), "node", "left")
    named = marked.withColumn("node", F.when(F.col("_several"), F.xxhash64("node", "check").bitwiseAND(-2)).otherwise(F.col("node")))
    renamed = cut(named.select(*info.columns, F.coalesce("_several", F.lit(False)).alias("_several")))
    return renamed.drop("_several"), renamed.filter("_several").select("node").distinct()


def among_likely(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root of the components of likely pairs (a, b, shared, must) that are similar, of all pairs that `must` be verified.

    A pair is verified with its sets, which are sent for each pair anew, and among near copies there are as many pairs as
    a set has copies. So each set is first held against two of its partners, that with most partners and that with most
    shared signatures; then what must be and is not in one component by these links is verified pair by pair.
    """
    both = cut(likely.select("a", "b", "shared").unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")))
    partners = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("partners"))
    first = both.hint("merge").join(partners.hint("merge"), "b").groupBy("a").agg(F.max_by("b", F.struct("partners", "b")).alias("hub"), F.max_by("b", F.struct("shared", "b")).alias("next"))
    first = first.select("a", F.explode(F.array("hub", "next")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = components(similar(first, sets))
    x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(r)).hint("merge") for c, r in (("a", "ra"), ("b", "rb")))
    rest = likely.filter("must").hint("merge").join(x, "a", "left").hint("merge").join(y, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return merged(roots, similar(rest.join(first, ["a", "b"], "left_anti"), sets))


def among_hard(hard: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """`roots` after the links among holders of common signatures: with leaders first, then in blocks whatever still spans components."""
    for leaders in (True, False):
        held = cut(hard.join(roots, "node", "left").select("sig", "node", "own", F.coalesce("root", "node").alias("root")))
        spanning = spanning_of(held)
        if spanning.isEmpty():
            break
        stars = spanning.filter("root <> largest").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        roots = merged(roots, similar(stars, sets) if leaders else in_blocks(spanning, sets))
    return roots


def spanning_of(held: DataFrame) -> DataFrame:
    """Of a table sig, node, own, root the rows of signatures that several components have, with the largest of these and a leader in it.

    What is known of signatures is written out, so that their join with rows is one whose large partitions AQE splits.
    """
    sizes = held.groupBy("sig", "root").agg(F.count("*").alias("k"), F.max(F.struct("own", "node")).alias("lead"))
    spans = cut(sizes.groupBy("sig").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.max_by("lead", F.struct("k", "root")).alias("lead"), F.count("*").alias("roots")).filter("roots > 1"))
    return cut(held.hint("merge").join(spans.hint("merge"), "sig").select("sig", "node", "own", "root", "largest", F.col("lead.node").alias("lead")))


def may_link(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n, tokens of those of the asked nodes (distinct `node`) that can be similar to another one of them.

    `tokens` are the shingles that another one has too. A similar set holds three quarters of a set at least, so where
    these are fewer there is none; what a set has alone is in no intersection.
    """
    asked = cut(sets.hint("merge").join(nodes.hint("merge"), "node"))
    rows = asked.select("node", F.explode("tokens").alias("token"))
    often = cut(rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"))
    kept = rows.hint("merge").join(often.hint("merge"), "token").groupBy("node").agg(F.collect_list("token").alias("tokens"))
    whole = asked.select("node", F.size("tokens").alias("n")).hint("merge").join(kept.hint("merge"), "node")
    return cut(whole.filter(F.size("tokens") * DEN >= F.col("n") * NUM))


def in_blocks(spanning: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a common signature, from each block those that join components not joined by its other links."""
    return cut(blocks_of(spanning, sets).groupBy("cluster", "i", "j").applyInPandas(block_links, "a long, b long"))


def blocks_of(spanning: DataFrame, sets: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """cluster, i, j, left, node, root, n, tokens: the sets to compare, dealt over the blocks (i, j) of each cluster.

    Of each cluster (what signatures of several components connect) the nodes outside the largest component of some
    signature are held against all. A side of a block is an eighth of its cluster's shingles, but `tile` at least and
    `block` at most: so a set is sent to 16 blocks at most as long as a cluster has no more than 8 million shingles,
    and a task's memory stays within bounds in larger ones, whose sets are sent the more often the more there are.
    """
    alike = may_link(spanning.select("node").distinct(), sets)
    spanning = spanning_of(cut(spanning.select("sig", "node", "own", "root").hint("merge").join(alike.select("node").hint("merge"), "node")))
    clusters = components(spanning.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    nodes = spanning.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("largest")).alias("few"))
    nodes = nodes.join(clusters.select("node", F.col("root").alias("cluster")), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    whole = cut(nodes.hint("merge").join(alike.hint("merge"), "node"))
    cost = F.size("tokens") + ROW
    sums = whole.groupBy("cluster").agg(F.sum(cost).alias("all"), F.sum(F.when(F.col("few"), cost).otherwise(0)).alias("of_few"))
    side = F.greatest(F.lit(tile), F.least(F.lit(block), F.col("all") / BLOCKS))
    counts = cut(sums.select("cluster", F.ceil(F.col("all") / side).cast("int").alias("blocks"), F.ceil(F.col("of_few") / side).cast("int").alias("few_blocks")))
    placed = whole.join(counts, "cluster")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("few").select("cluster", at("few_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("left"), "node", "root", "n", "tokens")
    right = placed.select("cluster", every("few_blocks").alias("i"), at("blocks").alias("j"), F.lit(False).alias("left"), "node", "root", "n", "tokens")
    return left.unionByName(right)


def tiles(side: pd.DataFrame, tile: int) -> list[tuple]:
    """Sets in the order of their sizes, some `tile` shingles at a time: shingles, the row of each, the distinct ones; sizes, roots, nodes of the rows."""
    side = side.sort_values("n", kind="stable")
    out = []
    for _, part in side.groupby(np.cumsum([len(t) + ROW for t in side["tokens"]]) // tile):
        flat, row = np.concatenate(part["tokens"].to_list()), np.repeat(np.arange(len(part)), [len(t) for t in part["tokens"]])
        out.append((flat, row, np.unique(flat), *(part[c].to_numpy() for c in ("n", "root", "node"))))
    return out


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the left and the right rows of a block that join different roots."""
    return tile_links(rows, TILE)


def tile_links(rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Those links, tile by tile; tiles whose sizes lie too far apart are left out."""
    out: list[tuple[int, int]] = []
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while top.get(r, r) != r:
            r = top[r]
        return r

    right = tiles(rows[~rows["left"]], tile)
    for flat_x, row_x, own_x, sizes_x, roots_x, nodes_x in tiles(rows[rows["left"]], tile):
        for flat_y, row_y, own_y, sizes_y, roots_y, nodes_y in right:
            if sizes_x[-1] * DEN < sizes_y[0] * NUM or sizes_y[-1] * DEN < sizes_x[0] * NUM:
                continue
            shared = np.intersect1d(own_x, own_y, assume_unique=True)
            counts = np.zeros((len(nodes_x), len(nodes_y)), np.float32)
            for k in range(0, len(shared), COLUMNS):
                some, grids = shared[k : k + COLUMNS], []
                for flat, row, n in ((flat_x, row_x, len(nodes_x)), (flat_y, row_y, len(nodes_y))):
                    at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
                    hit = some[at] == flat
                    grid = np.zeros((n, len(some)), np.float32)
                    grid[row[hit], at[hit]] = 1
                    grids.append(grid)
                counts += grids[0] @ grids[1].T
            sizes = sizes_x[:, None] + sizes_y[None, :]
            similar_ = (counts * (DEN + NUM) >= sizes * NUM) & (roots_x[:, None] != roots_y[None, :])
            for i, j in zip(*np.nonzero(similar_), strict=True):
                p, q = find(int(roots_x[i])), find(int(roots_y[j]))
                if p != q:
                    top[p] = q
                    out.append((int(nodes_x[i]), int(nodes_y[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def against_all(lacking: DataFrame, docs: DataFrame, info: DataFrame) -> DataFrame:
    """Links of the few sets that have too few units, counted shingle by shingle against all sets of such sizes."""
    nodes = info.filter("node IS NOT NULL").select("node", "n").dropDuplicates(["node"])
    sizes = nodes.hint("merge").join(lacking.hint("merge"), "node").agg(F.min("n"), F.max("n")).first()
    near = nodes.filter((F.col("n") * DEN >= sizes[0] * NUM) & (F.col("n") * NUM <= sizes[1] * DEN)).select("node") if sizes[0] else nodes.select("node").limit(0)
    sets = cut(sets_of(near, docs, info))
    rows = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    few = cut(rows.hint("merge").join(lacking.hint("merge"), "node").select(F.col("node").alias("a"), F.col("n").alias("n_a"), "token"))
    met = few.hint("merge").join(rows.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "token").hint("merge"), "token").filter("a <> b")
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return cut(counted.filter((F.col("n_a") + F.col("n_b")) * NUM <= F.col("k") * (DEN + NUM)).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set holds the distinct five-word
    shingles, or the whole sequence of a shorter text. Null, empty and blank texts have the empty set and are a
    component of their own. Sets are linked from a similarity of 0.75 on (ties included), and equal sets always;
    component_id is the smallest doc_id that links reach. Repeated rows get equal results. Rows without an id
    take part, and have a component_id where a linked document has an id. Other columns are not read.
    """
    info, roots = linked(docs, id_col, text_col, common)
    smallest = info.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    whole = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = cut(whole)
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.hint("merge").join(least.hint("merge"), "root").select("node", "component_id")
    return info.hint("merge").join(named.hint("merge"), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of the rows of `docs` one of each component, with all their columns, whatever their names.

    The row with the smallest doc_id stays, null ids last, of equals one by its text's hash; of rows that repeat an id
    each is judged by its own text. Rows without words (null, empty, blank) are components of their own and stay, repeated
    ones once for each id, or each where they have none. An empty table gives an empty one.
    """
    info, roots = linked(docs)
    rooted = info.hint("merge").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.filter("node IS NOT NULL").groupBy("root").agg(F.min_by(F.struct("doc_id", "_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("b"))
    blank = info.filter("node IS NULL AND doc_id IS NOT NULL").select("doc_id", "_key").groupBy("doc_id").agg(F.min("_key").alias("_key"))
    chosen = cut(best.select("b.doc_id", "b._key").unionByName(blank))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_key"))
    wordless = rows.filter(F.col("doc_id").isNull() & ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("row")
    named = rows.hint("merge").join(chosen.hint("merge"), (rows.doc_id.eqNullSafe(chosen.doc_id)) & (rows._key == chosen._key), "left_semi")
    return named.dropDuplicates(["doc_id", "_key"]).select("row").unionByName(wordless).select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
