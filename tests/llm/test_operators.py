"""The operators against brute-force versions, on small tables with the awkward cases in them."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.llm import decontaminate, exact_dedup, jaccard_join, licenses, mixing, quality, secrets, sharding, tool_calls, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, size string"


def table(spark, texts, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[k], None, "k", "n", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(seed, n, words=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + str(rng.randrange(9)) for _ in range(words)) for _ in range(n)]


ODD = [(1000, None), (1001, ""), (1002, "   \n\t"), (1003, "one"), (1004, "Ünï çödé words hère ﬁne"), (None, "no id at all here"), (1005, "x " * 30_000)]


# 4 ------------------------------------------------------------------------------------------------------


def dedup_truth(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 8000])
def test_exact_dedup(spark, budget):
    base = sentences(1, 30)
    rows = [(i, random.Random(i).choice(base)) for i in range(200)] + [(300, base[0] + " "), (301, base[0].replace(" ", "\n\t")), (5, base[3]), (5, base[3])] + ODD
    got = exact_dedup.exact_dedup(table(spark, rows), budget=budget)
    assert Counter(tuple(r) for r in got.collect()) == dedup_truth(rows)
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_trie_gives_a_subtree_away():
    trie = exact_dedup.Trie()
    for k in (b"abc", b"abd", b"xyz", b"ab", b""):
        assert trie.add(k, k.hex(), 1, 1) is None
    name, gone = trie.give()
    assert name and {k for k, _ in gone} | {k for k, _ in trie.strings()} == {b"abc", b"abd", b"xyz", b"ab", b""}
    assert trie.add(gone[0][0], "", 1, 1) is not None


def test_trie_counts_what_it_holds():
    """However often subtrees go, the count is that of the nodes there are."""
    rng, trie, peak = random.Random(2), exact_dedup.Trie(), 0
    for n in range(4000):
        trie.add(bytes(rng.choice(b"abcdef") for _ in range(12)), "", 1, 1)
        if trie.size > 40_000:
            trie.give()
        peak = max(peak, trie.size)
        if n % 100 == 0:
            nodes = [trie.root]
            for x in nodes:
                nodes += x.children.values()
            assert trie.size == sum(len(x.label) + exact_dedup.NODE for x in nodes[1:])
    assert peak < 41_000


# 5 ------------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def components_truth(rows):
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("common", [jaccard_join.COMMON, 3, 9])
def test_jaccard_components(spark, common):
    rng = random.Random(7)
    texts = []
    for k, base in enumerate(sentences(2, 6, 90) + sentences(3, 4, 300) + sentences(4, 8, 9)):
        texts += [base, base.upper()] + [edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 30)) for _ in range(12 if k < 2 else 4)]
    passage = sentences(5, 1, 60)[0]
    texts += [passage + " " + s for s in sentences(6, 25, 30)]  # mostly one passage, and not similar
    rows = list(enumerate(texts)) + ODD + [(3, texts[3]), (2000, "one"), (2001, "two words")]
    info, roots = jaccard_join.linked(table(spark, rows), common=common)
    assert info.count() == len(rows) and roots.count() > 0
    got = jaccard_join.jaccard_components(table(spark, rows), common=common)
    assert Counter(tuple(r) for r in got.collect()) == components_truth(rows)


def test_jaccard_allocation(spark):
    rng = np.random.default_rng(1)
    for size in [*range(1, 70), 255, 256, 300, 1000, 1023, 1024, 1300]:
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        band, more = jaccard_join.bands(size)[0], int(rng.integers(0, size // 3 + 1))
        b = np.unique(np.concatenate((a, rng.integers(0, 2**63, more, dtype=np.uint64))))
        shared = {int(x) for x in jaccard_join.signatures(a, band)} & {int(x) for x in jaccard_join.signatures(b, band)}
        exact, units = jaccard_join.worth(a, band)
        both = min(units, jaccard_join.worth(b, band)[1])
        assert exact <= units <= jaccard_join.allotment(size, band) and len(shared) >= both - more
        assert size < 4 or jaccard_join.segments_of(band) < size * 5 and len(jaccard_join.signatures(a, band)) <= max(12, 0.6 * size)


@pytest.mark.parametrize("length", [20, 300])
def test_rounds_of_contraction_stay_few(spark, monkeypatch, length):
    """A path whose ids ascend, which contraction by a fixed order walks step by step, beside stars, a cycle and a loop."""
    tables = []
    monkeypatch.setattr(jaccard_join, "cut", lambda df, old=jaccard_join.cut: tables.append(1) or old(df))
    star, cycle = [(5000, 5001 + i) for i in range(40)], [(6000 + i, 6000 + (i + 1) % 9) for i in range(9)]
    edges = [(i, i + 1) for i in range(length)] + star + cycle + [(7000, 7000), (1, 0)]
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long"))
    groups = defaultdict(set)
    for node, root in (tuple(r) for r in got.collect()):
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == [[*range(length + 1)], [*range(5000, 5041)], [*range(6000, 6009)]] and all(root in group for root, group in groups.items())
    rounds = (len(tables) - 1) / 3
    assert rounds <= 3 * np.log2(length)


def test_sets_are_read_by_id_and_hash(spark):
    """Texts whose hash is one and the same are told apart by their ids, null ones too."""
    rows = [(1, "a b c d e f"), (2, "other words stand here now"), (None, "a third text of six words")]
    docs = table(spark, rows).select("doc_id", "text", F.lit(7).cast("long").alias("_key"))
    info = docs.select("_key", "doc_id", "text").mapInArrow(jaccard_join.informer, jaccard_join.INFO)
    got = {r["node"]: set(r["tokens"]) for r in jaccard_join.sets_of(info.select("node").distinct(), docs, info).collect()}
    want = {jaccard_join.node_of(t): set(t.view(np.int64).tolist()) for t in (jaccard_join.shingles(text) for _, text in rows)}
    assert got == want


def test_words_that_polynomials_confuse(spark):
    """Words of Thue-Morse letters, which any polynomial modulo a power of two hashes alike, are different words."""
    ab = "a"
    for _ in range(11):
        ab += ab.translate(str.maketrans("ab", "ba"))
    ba = ab.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        rows = [(1, ab[:n]), (2, ba[:n]), (3, f"{ab[:n]} x y z u v"), (4, f"{ba[:n]} x y z u v")]
        assert [r[2] for r in sorted(tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows)).collect())] == [1, 2, 3, 4]


def test_sets_of_one_identity(spark, monkeypatch):
    """Different sets whose identities collide are still told apart, and linked rightly."""
    texts = sentences(14, 6, 40) + [s + " tail" for s in sentences(14, 6, 40)] + ["odd one", "odd one"]
    rows = list(enumerate(texts))
    info = table(spark, rows).select(F.xxhash64("doc_id", "text").alias("_key"), "doc_id", "text").mapInArrow(jaccard_join.informer, jaccard_join.INFO)
    collided = info.withColumn("node", F.when(F.col("doc_id").isin(1, 2, 9), 4242).otherwise(F.col("node")))
    apart, doubled = jaccard_join.told_apart(collided)
    nodes = {r["doc_id"]: r["node"] for r in apart.collect()}
    assert len(nodes) == 14 and nodes[12] == nodes[13] and len(set(nodes.values())) == 13 and {r["node"] for r in doubled.collect()} == {nodes[1], nodes[2], nodes[9]}
    docs = table(spark, rows).select("doc_id", "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    names = {n: i for i, n in nodes.items()}
    assert {frozenset((names[r["a"]], names[r["b"]])) for r in jaccard_join.against_all(doubled, docs, apart).collect()} == {frozenset((1, 7)), frozenset((2, 8)), frozenset((9, 3))}


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are in this"), (4, ""), (4, None), (None, "z"), (None, "z"), (None, ""), (None, " "), (5, "unlike all the others here"), (5, "a b c d e f"), (6, "unlike all the others here")]
    clashing = table(spark, rows).toDF("doc_id", "text", "_key", "_kept", "node", "root", "row", "n")
    kept = jaccard_join.first_of_each(clashing)
    assert kept.columns == clashing.columns
    assert Counter((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect()) == Counter([(1, "a b c d e f"), (3, "other words are in this"), (4, ""), (None, "z"), (None, ""), (None, ""), (5, "unlike all the others here")])
    assert jaccard_join.first_of_each(clashing.limit(0)).count() == jaccard_join.jaccard_components(clashing.limit(0)).count() == 0


def families(seed):
    """Sets by node: of a family whose members are similar or nearly so, of one of other sizes, and some that share a passage alone."""
    rng, sets = np.random.default_rng(seed), {}
    drawn = lambda n: rng.integers(-(2**62), 2**62, n)
    for start, base, members, most in ((0, drawn(120), 150, 24), (1000, drawn(40), 60, 10), (2000, drawn(30), 40, 0)):
        for k in range(members):
            kept = rng.permutation(base)[: len(base) - rng.integers(0, most + 1)]
            sets[2 * (start + k)] = np.unique(np.concatenate((kept, drawn(rng.integers(0, most + 1) if most else 60))))
    return sets


def groups_of(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        top[find(a)] = find(b)
    return {n: find(n) for n in nodes}, len({find(n) for n in nodes})


def same_groups(sets, links):
    """Links join what is similar, and nothing else."""
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))]
    assert {(min(x), max(x)) for x in links} <= {(min(x), max(x)) for x in alike}
    both, n = groups_of(sets, [*alike, *links])
    return n == groups_of(sets, links)[1] == groups_of(sets, alike)[1] and len(alike) > 100


def test_sets_are_sent_to_few_blocks(spark):
    """A set goes to so many blocks however many sets share its signature, and those that can have no links go to none."""
    sets = families(1)
    spanning = spark.createDataFrame([(start, n, 1, n, (lead := 2 * start), lead) for start in (0, 1000, 2000) for n in sets if start <= n // 2 < start + 1000], "sig long, node long, own int, root long, largest long, lead long")
    tokens = spark.createDataFrame([(n, t.tolist()) for n, t in sets.items()], "node long, tokens array<long>")
    sent = jaccard_join.blocks_of(spanning, tokens, tile=200).groupBy("node").agg(F.count("*").alias("times"), F.max("cluster").alias("cluster")).collect()
    times = {r["node"]: r["times"] for r in sent}
    # 200 shingles a block would send each set of the first family to some 200 blocks.
    assert 8 < max(times.values()) <= 2 * jaccard_join.BLOCKS and not any(n >= 4000 for n in times) and len({r["cluster"] for r in sent}) == 2
    assert same_groups(sets, [(r["a"], r["b"]) for r in jaccard_join.in_blocks(spanning, tokens).collect()])
    apart = spanning.filter("node >= 4000")
    assert jaccard_join.in_blocks(apart, tokens).count() == 0


@pytest.mark.parametrize("tile", [100, 1500, jaccard_join.TILE])
def test_tiles_of_a_block(tile):
    sets = families(2)
    rows = pd.DataFrame([(left, n, n, len(t), t) for left in (True, False) for n, t in sets.items()], columns=["left", "node", "root", "n", "tokens"])
    assert same_groups(sets, [tuple(x) for x in jaccard_join.tile_links(rows, tile).to_numpy().tolist()])
    assert jaccard_join.tile_links(rows[rows["left"]], tile).empty and jaccard_join.tile_links(rows[~rows["left"]], tile).empty


def test_shuffles_go_with_their_query(spark):
    """What a step has shuffled is not left on disk until the driver collects its garbage."""
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = spark.conf.get(setting), files()
    jaccard_join.linked(table(spark, list(enumerate(sentences(15, 20, 30) * 2))))
    until = time.time() + 20
    while (left := files() - kept) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(setting) == before


def test_lacking_sets_are_counted_against_all(spark):
    rows = [(i, t) for i, t in enumerate(sentences(8, 5, 30))] + [(10, sentences(8, 5, 30)[0] + " tail")]
    docs = table(spark, rows).select("doc_id", "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    info = docs.select("_key", "doc_id", "text").mapInArrow(jaccard_join.informer, jaccard_join.INFO)
    found = jaccard_join.against_all(info.select("node").distinct(), docs, info)
    names = {r["node"]: r["doc_id"] for r in info.collect()}
    assert {frozenset((names[r["a"]], names[r["b"]])) for r in found.collect()} == {frozenset((0, 10))}


# 10 -----------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_truth(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = plain_words(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if got := wins.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination(spark):
    items = [(i, t) for i, t in enumerate(sentences(11, 12, 25))] + [(50, "tiny item"), (51, None), (52, ""), (53, sentences(11, 12, 25)[0]), (54, "four words stand here")]
    rows = []
    for i, s in enumerate(sentences(12, 40, 50)):
        w, item = s.split(), (items[i % 12][1]).split()
        rows.append((i, " ".join(w[:20] + item[i % 9 : i % 9 + i] + w[20:]) if i % 2 else s))
    rows += [(90, items[1][1].upper() + "! " + items[1][1]), (91, "a Tiny, ITEM; tiny item tiny"), (92, "four words stand here")] + ODD + [(90, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.contamination(table(spark, rows), bench).collect()) == contamination_truth(rows, items)
    clean = {r["doc_id"] for r in decontaminate.clean_documents(table(spark, rows), bench).collect()}
    assert clean == {r[0] for r in contamination_truth(rows, items) if not r[5]}
    assert decontaminate.contamination(table(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(table(spark, rows).limit(0), bench).count() == 0
    decontaminate.BROADCAST_ROWS, before = 0, decontaminate.BROADCAST_ROWS
    try:
        assert Counter(tuple(r) for r in decontaminate.contamination(table(spark, rows), bench).collect()) == contamination_truth(rows, items)
    finally:
        decontaminate.BROADCAST_ROWS = before


# 6 ------------------------------------------------------------------------------------------------------


def test_fair_targets_and_flow():
    assert mixing.fair_targets([100, 100, 10], [3, 1, 2], 315, 2) == pytest.approx([200, 95, 20])
    assert mixing.fair_targets([], [], 0, 2) == []
    flow = mixing.cheapest_flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 25, "b": 8}, 2)
    assert sum(n for (p, s), n in flow.items() if s == "a") == 25 and sum(n for (p, s), n in flow.items() if s == "b") == 8
    assert all(sum(n for (q, _), n in flow.items() if q == p) <= 2 * k for p, k in {("a",): 10, ("a", "b"): 10, ("b",): 2}.items())


def test_flow_of_many_patterns():
    """Least cost against every way on small networks; and ten thousand patterns in seconds."""
    rng = random.Random(4)
    for _ in range(60):
        names = "abc"[: rng.randrange(1, 4)]
        supply = {p: rng.randrange(1, 4) for p in {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))) for _ in range(3)}}
        quota = {s: rng.randrange(0, 7) for s in names}
        flow = mixing.cheapest_flow(supply, quota, 2)
        sends = {p: sum(n for (q, _), n in flow.items() if q == p) for p in supply}
        gets = {s: sum(n for (_, t), n in flow.items() if t == s) for s in names}
        assert all(0 <= sends[p] <= 2 * n for p, n in supply.items()) and all(gets[s] <= quota[s] for s in names)

        def feasible(want):  # Hall: every set of sources can take what only it is sent
            groups = [set(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]
            return all(sum(w for p, w in want.items() if set(p) <= g) <= sum(quota[s] for s in g) for g in groups)

        options = [dict(zip(supply, w, strict=True)) for w in itertools.product(*[range(2 * n + 1) for n in supply.values()])]
        cost = lambda want: sum(w + 2 * max(0, w - supply[p]) for p, w in want.items())
        best = min((-sum(w.values()), cost(w)) for w in options if feasible(w))
        assert (-sum(sends.values()), cost(sends)) == best
    supply = {tuple(sorted(rng.sample(range(400), rng.randrange(1, 5)))): rng.randrange(1, 10_000) for _ in range(10_000)}
    began = time.time()
    flow = mixing.cheapest_flow(supply, {s: rng.randrange(50_000, 400_000) for s in range(400)}, 2)
    assert time.time() - began < 60 and sum(flow.values()) > 0


def test_mixture_keeps_clashing_columns(spark):
    rows = [(1, "a b c", "s", 1, 1, 1, 1), (1, "a b c", "s", 2, 2, 2, 2), (1, None, "s", 3, 3, 3, 3), (None, "d e", None, 4, 4, 4, 4), (2, "", "t", 5, 5, 5, 5), (3, "w " * 50_000, "t", 6, 6, 6, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _doc int, _times int, _copy int, row int")
    got = mixing.mixture(docs)
    assert got.columns == docs.columns and {r["row"] for r in got.collect()} <= {1, 2, 4, 6} and mixing.mixture(docs.limit(0)).count() == 0


def test_mixing(spark):
    texts = sentences(20, 120, 30)
    rows = [(i, t if i % 5 else t[: i * 2]) for i, t in enumerate(texts)] + ODD + [(7, texts[7]), (7, texts[7])]
    sources = [["a", "b", "c", "Z", None][min(4, i % 9)] for i in range(len(rows))]
    docs = table(spark, rows, sources)
    got = mixing.mix(docs, F.array("source")).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        (s,) = r["member"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["of"][0]["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["of"][0]["words"] > -1
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(size.values()) == sum(count(t) for _, t in rows)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert order[0] == "Z" and order[-1] is None
    assert [target[s] for s in order] == pytest.approx(mixing.fair_targets([size[s] for s in order], [3, 1, 2, 3, 1], 1.5 * sum(size.values()), 2))
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix(docs.repartition(7), F.array("source")).collect()
    key = lambda rows_: Counter((r["doc_id"], r["size"], r["taken"]) for r in rows_)
    assert key(got) == key(again)
    assert mixing.mix(docs.limit(0), F.array("source")).count() == 0
    times = Counter(r["doc_id"] for r in mixing.mixture(docs).collect())
    assert all(times[r["doc_id"]] >= -(-r["taken"] // max(1, r["size"])) for r in got)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10) for i in range(60)]
    docs = table(spark, rows, [["a", "b", "a,b"][i % 3] for i in range(60)])
    got = mixing.mix(docs, F.split("source", ",")).collect()
    total = Counter()
    for r in got:
        total[tuple(r["member"])] += r["taken"]
    quotas = {s["source"]: s["target"] for r in got for s in r["of"]}
    assert sum(total.values()) == pytest.approx(min(1200, sum(quotas.values())), abs=2)


# 7 ------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    texts = sentences(30, 400, 20)
    rows = [(i, texts[i] if i % 3 else "hot text " * 9) for i in range(400)] + ODD + [(9, "twice"), (9, "twice")]
    for ranges, sample in ((1024, 16384), (8, 64)):
        got = sharding.shards_by_bytes(table(spark, rows), shards=8, ranges=ranges, sample=sample).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        by, slots = Counter(), defaultdict(list)
        for r in got:
            by[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        # One text is as large as several shards here; all other shards are near the share.
        assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    small = [r for r in rows if r[0] != 1005]
    by = Counter()
    for r in sharding.shards_by_bytes(table(spark, small), shards=8, ranges=16, sample=128).collect():
        by[r["shard"]] += r["size"]
    share = sum(by.values()) / 8
    assert len(by) == 8 and all(abs(x - share) < 0.1 * share for x in by.values())
    assert sharding.shards_by_bytes(table(spark, rows).limit(0)).count() == 0


def shards_of(got):
    by, homes = Counter(), defaultdict(set)
    for r in got:
        by[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    return by, homes


def test_equal_texts_share_a_shard(spark):
    """Copies in groups of 7, of which each is a twentieth of a shard; and a few groups of half a share and more."""
    rows = [(i, t) for i, t in enumerate(t for t in sentences(31, 331, 20) for _ in range(7))]
    by, homes = shards_of(sharding.shards_by_bytes(table(spark, rows)).collect())
    share = sum(by.values()) / 16
    assert len(homes) == 331 and all(len(x) == 1 for x in homes.values()) and all(abs(x - share) < 0.06 * share for x in by.values())
    big = sentences(32, 3, 30)
    rows += [(10_000 + i, big[0]) for i in range(70)] + [(20_000 + i, big[1]) for i in range(40)] + [(30_000 + i, big[2]) for i in range(900)]
    got = sharding.shards_by_bytes(table(spark, rows), sample=4096).collect()
    by, homes = shards_of(got)
    share, crc = sum(by.values()) / 16, [zlib.crc32(t.encode()) for t in big]
    assert all(abs(x - share) < 0.06 * share for x in by.values())
    # One text alone is larger than two shares, and is cut; no other is.
    assert len(homes.pop(crc[2])) > 1 and all(len(x) == 1 for x in homes.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_arranged():
    plan, begins = sharding.arranged([(0, 10, 1, 1), (1, 40, 2, 2), (2, 30, 3, 9), (3, 80, 11, 11), (4, 40, 12, 20)], 4)
    assert plan == [(0, 1, True, 0), (1, 0, True, 0), (2, None, False, 0), (3, None, True, 30), (4, None, False, 110)] and begins == [10, 50, 100]


# 2 ------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(3)
    good = sentences(40, 150, 40)
    bad = [" | ".join(s.split()) if i % 2 else " ".join(w.upper() + "!!" for w in s.split()) for i, s in enumerate(sentences(41, 90, 40))]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows if rng.random() < 0.8] + [(None, 1, 0), (3, None, 0), (999_999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + ODD)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect() if r["doc_id"] is not None}
    assert len(got) == len(rows) + len(ODD) - 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i < 150) for i in held) >= 0.95 * len(held)
    # Labels that are held out change nothing.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, turned).collect()} == {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert {r["predicted"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1}
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(150) if got[i]["predicted"]}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


# 3 ------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["https://A.example.ORG/es/1", "https://example.org/en/12?x", "http://other.org/fr/", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "ftp://h.net", "http://h.net/p?b=2&a=1&utm_x=3#f", "h.net/p",
            None, "", "://", "http://HOST.net?q", "http://notexample.org/es/", "http://h.net:80/p/?a=1&b=2", "http://q.net/" + "a" * 50_000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, key string")
    listed = spark.createDataFrame([("https://h.net/p?a=1&b=2",), (None,), ("nothing",)], "url string")
    for blocks in (url_filter.MAX_BLOCKS, 1):
        got = url_filter.url_verdicts(pages, listed, max_blocks=blocks).collect()
        assert len(got) == len(urls) + 1

        def truth(u):
            host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"(?s).*?://([^/?#]*)", u)[1]) if u and "://" in u else ""
            path = re.match(r"(?s).*?://[^/?#]*([^?#]*)", u)[1] if u and "://" in u else ""
            fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            hit = u in (urls[7], urls[14])
            return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if hit else "allow", hit

        assert all((r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == truth(urls[r["page_id"]]) for r in got)
    assert url_filter.url_verdicts(pages.limit(0), listed).count() == 0
    assert {r["listed"] for r in url_filter.url_verdicts(pages, listed.limit(0), []).collect()} == {False}


def test_junk_hosts_are_listed(spark, tmp_path):
    junk = ["m.casino-win.example.com", "free-bets.example.com", "ads-track.example.net:80", "Spammers.example.net", "www.cheap-pills.example.net", "blog.adult-x.example.net"]
    fair = ["adsl.example.com", "alphabets.example.com", "casinoville.example.com", "adulthood.example.net", "caterpillars.example.net", "antispam.example.net"]
    rows = [(i, f"http://{h}/x/{i}") for i, h in enumerate(junk + fair)] + [(90, "https://www.cheap-pills.example.net:443/x/4/?utm_a=1"), (91, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["verdict"], r["listed"]) for r in url_filter.op3_url_filter_junk(spark, str(tmp_path)).collect()}
    assert {k for k, v in got.items() if v == ("block", True)} == {*range(len(junk)), 90} and {k for k, v in got.items() if v == ("allow", False)} == {*range(len(junk), len(junk + fair)), 91}


# 8 ------------------------------------------------------------------------------------------------------


def spans_truth(text):
    text, out = text or "", []
    for k, (kind, pattern, flags, group, least) in enumerate(secrets.RULES):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    rng = random.Random(5)
    parts = ["pass" + "word = 'abcdefgh1'", "API" + "_KEY: zzzzzzzz", "apikey=short", "to" + "ken = \"" + "0f" * 20 + '"', "AKIA" + "Q" * 16, "AKIA" + "Q" * 5, "dead" * 9, "ab" * 10, "ſecret = abcdefghij", "gh" + "p_" + "A1" * 19, "é" * 7,
             "-----BEGIN " + "RSA PRIVATE KEY-----", "x" * 3000, "pass" + "wd:secret:abcdefghijkl", "\n", "xox" + "b-" + "1" * 14]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(300)] + ODD
    got = secrets.secret_spans(table(spark, rows))
    assert Counter((r["doc_id"], tuple(r["found"])) for r in got.collect()) == Counter((i, tuple(spans_truth(t))) for i, t in rows)
    assert secrets.secret_spans(table(spark, rows).limit(0)).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query(*secrets.RULES[0][1:3])
    assert q and any({b"tok", b"oke", b"ken"} <= grams for alternatives in q for grams in alternatives)
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[{b"aki", b"kia"}]]
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("(abc)+x?(def|ghi)?") == [[{b"abc"}]]


# 9 ------------------------------------------------------------------------------------------------------


def base_truth(text):
    w = plain_words(text)
    places = [(i, label) for label, phrase, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_truth(rows):
    """Every template at every start, by the definition."""
    every = [(label, plain_words(t), plain_words(key)) for label, t, key in [*licenses.BASE, *licenses.TEXTS]]
    texts = [plain_words(t) for _, t in rows]
    df = Counter(w for t in texts for w in set(t))
    weight = lambda w: max(np.log((len(rows) + 1) / (df[w] + 1)), 0.01)
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        labels, best = set(), 0.0
        for k, (label, t, key) in enumerate(every):
            at, total = next(i for i in range(len(t)) if t[i : i + len(key)] == key), sum(map(weight, t))
            for p in (i for i in range(len(w)) if w[i : i + len(key)] == key):
                share = sum(weight(x) for i, x in enumerate(t) if 0 <= p - at + i < len(w) and w[p - at + i] == x) / total
                if share >= (0.999999 if k < len(licenses.BASE) else licenses.COVER):
                    labels.add(label)
                    best = max(best, min(1.0, share))
        out.append((d, ",".join(sorted(labels)), round(best, 9)))
    return Counter(out)


def test_license_texts(spark):
    texts = {k: (label, t) for k, (label, t, _) in enumerate(licenses.TEXTS)}
    rows = [(k, f"some words before it {t} and after it") for k, (_, t) in texts.items()] + [(100 + k, t.replace("copy", "COPY ", 1).replace("software", "program", 1)) for k, (_, t) in texts.items()] + [(200, licenses.TEXTS[1][1][40:]), (201, licenses.TEXTS[2][1][:60])] + ODD
    got = licenses.licenses(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == license_truth(rows)
    named = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert all(label in named[k] for k, (label, _) in texts.items()) and named[201] == [""]


def test_licenses(spark):
    lines = ["Released under the MIT License.", "MIT licensed", "the mit  LICENSE mit license", "Apache-License v2", "GNU General Public License, version 3", "general public", "Licensed under CC BY-NC 4.0", "mit", "license"]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(lines + sentences(i, 2, 6)) for _ in range(rng.randrange(6)))) for i in range(150)] + ODD + [(1, "MIT license"), (1, "nothing")]
    assert licenses.licenses(table(spark, rows).limit(0)).count() == 0
    got = licenses.licenses(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((i, *base_truth(t)) for i, t in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert bool(r["labels"]) == (r["score"] > 0)
    assert "cc-by-nc" in {x for r in got for x in r["labels"].split(",")}
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == license_truth(rows)
    assert licenses.licenses(table(spark, rows).limit(0)).count() == 0


def test_reserved_rights_are_a_license(spark):
    rows = [(1, "Some words. All rights reserved."), (2, "ALL RIGHTS, reserved; the MIT License"), (3, "all rights are reserved"), (4, "rights reserved all"), (5, None), (6, "This is free and unencumbered software released into the public domain.")]
    got = {r["doc_id"]: (r["labels"], r["n_base"], r["score"] > 0) for r in licenses.licenses(table(spark, rows)).collect()}
    assert got == {1: ("all-rights-reserved", 0, True), 2: ("all-rights-reserved,mit", 1, True), 3: ("", 0, False), 4: ("", 0, False), 5: ("", 0, False), 6: ("unlicense", 0, True)}


# 1 ------------------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    call = lambda **k: f"<tool_call>{json.dumps(k)}</tool_call>"
    schemas = {"add": {"x": ("integer", True), "y": ("number", True), "note": ("string", False)}}
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call(id="a", name="add", arguments={"y": 2.5, "x": 1}) + call(id="b", name="add", arguments={"x": "1"}, depends_on=["a", "zz"])),
        (1, 2, "tool", '<tool_result>{"id":"a","content":"3.5"}</tool_result><tool_result>{"id":"q","content":"?"}</tool_result>'), (1, 3, "assistant", call(id="c", name="nope", arguments=[1], depends_on=["b"])),
        (2, 0, "assistant", call(id="a", name="add", arguments={"x": 1, "y": 1, "z": 0}, depends_on=["b"]) + call(id="b", name="add", arguments={"x": 1, "y": 1}, depends_on=["a"])),
        (2, 1, "assistant", "<tool_call>not json</tool_call>"), (3, 0, None, None), (None, None, "user", ""),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_calls(*tool_calls.inline_calls(messages), schemas).collect()}
    assert got[1, "a"]["arguments"] == '{"x":1,"y":2.5}' and got[1, "a"]["valid"] and got[1, "a"]["result"] == "3.5" and got[1, "a"]["status"] == "linked"
    assert [got[1, k]["topo_level"] for k in "abc"] == [0, 1, 2] and got[1, "b"]["errors"] == "x is not of type integer; y is missing" and got[1, "b"]["status"] == "unanswered"
    assert got[1, "c"]["errors"] == "arguments are not an object" and got[1, "q"]["status"] == "orphan" and got[2, "a"]["status"] == got[2, "b"]["status"] == "cycle"
    assert got[2, "a"]["errors"] == "z is not known" and got[2, None]["status"] == "unnamed"
    assert list(json.loads(got[1, "a"]["record"])) == sorted(json.loads(got[1, "a"]["record"]))
    plain = tool_calls.link_calls(*tool_calls.from_turns(messages))
    assert plain.count() == 5  # two calls, one of them answered, and three answers to no call
    assert tool_calls.link_calls(*tool_calls.from_turns(messages.limit(0))).count() == 0
    assert spark.range(1).select(tool_calls.canonical_json(F.lit('{"b":[1, 2],"a":{"d":null,"c":"é\\n"}}'))).first()[0] == '{"a":{"c":"é\\n","d":null},"b":[1,2]}'


def test_tool_call_keys_numbers_and_clashes(spark):
    deep = {"t": {"o": ("object", True, {"properties": {"k": ("string", True, {"enum": ["a", "b"]}), "n": ("number", False, {"minimum": 0, "maximum": 9})}}), "l": ("array", False, {"items": "integer"})}}
    rows = [("a/b", "c", 0, 0, "t", '{"o":{"k":"a","n":1e1},"l":[1,"x"]}', None), ("a", "b/c", 0, 0, "t", '{"o":{"k":"z"}}', ["b/c"]), (None, "c", 0, 0, "t", '{"o":{"q":1}}', [None]), ("", "c", 0, 0, "t", "", []), ("a/b", "c", 0, 0, "t", None, []), ("", "d", 1, 0, "t", json.dumps({"o": {"k": "b\\\" 1.0,[2e0]" * 20_000, "n": 2.50}}), [])]
    calls = spark.createDataFrame([(*r, 7, "g", "k") for r in rows], "conv_id string, call_id string, turn long, place int, name string, arguments string, depends_on array<string>, level int, got string, key string")
    results = spark.createDataFrame([("a/b", "c", 2, "second", 1), ("a/b", "c", 1, "first", 1), (None, "c", 1, "null's", 1)], "conv_id string, call_id string, turn long, content string, level int")
    got = {(r["conv_id"], r["call_id"], r["arguments"] is None): r for r in tool_calls.link_calls(calls, results, deep).collect()}
    assert len(got) == 6 and got["a/b", "c", False]["result"] == got["a/b", "c", True]["result"] == "first" and got["a", "b/c", False]["status"] == "cycle" and got[None, "c", False]["result"] == "null's" and got["", "c", True]["status"] == "unanswered"
    assert got["a/b", "c", False]["errors"] == "an item of l is not of type integer; o.n is above 9" and got["a", "b/c", False]["errors"] == "o.k is none of a, b" and got[None, "c", False]["errors"] == "o.k is missing; o.q is not known"
    assert got["a/b", "c", False]["arguments"] == '{"l":[1,"x"],"o":{"k":"a","n":10}}' and got["", "c", True]["errors"] == "arguments are not JSON"
    long = got["", "d", False]
    assert json.loads(long["arguments"]) == {"o": {"k": "b\\\" 1.0,[2e0]" * 20_000, "n": 2.5}} and long["arguments"].endswith('"n":2.5}}') and json.loads(long["record"])["arguments"]["o"]["n"] == 2.5
    one = lambda t: spark.range(1).select(tool_calls.canonical_json(F.lit(t))).first()[0]
    assert one("[1e2,100,100.0,-1.50,0.1,12345678901234567890,1e30]") == "[100,100,100,-1.5,0.1,12345678901234567890,1.0E30]" and one("1e2") == one("100") and one('{"a":1,"a":2}') is None


def levels_truth(edges, calls):
    needs = {c: {on for key, on in edges if key == c} for c in calls}
    level = {}
    while ready := {c for c, on in needs.items() if c not in level and all(d in level for d in on)}:
        level |= {c: max((level[d] + 1 for d in needs[c]), default=0) for c in ready}
    return {c: level.get(c) for c in calls}


def test_levels_of_calls(spark, monkeypatch):
    """Random dependencies, chains, cycles and what is behind them, and long chains in few rounds."""
    tables = []
    monkeypatch.setattr(tool_calls, "cut", lambda df, old=tool_calls.cut: tables.append(1) or old(df))
    rng, edges, calls = random.Random(3), [], []
    for conv in range(30):
        n = 12
        calls += [(conv, i) for i in range(n)]
        for i in range(1, n):
            back = rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))
            edges += [((conv, i), (conv, j)) for j in back]
        if conv % 3 == 0:  # a cycle, or a call that waits for itself
            i, j = rng.randrange(n), rng.randrange(n)
            edges.append(((conv, i), (conv, j)))
    calls += [(99, i) for i in range(400)] + [(None, i) for i in range(3)] + [(98, i) for i in range(5)]
    edges += [((99, i), (99, i - 1)) for i in range(1, 400) if i != 200] + [((None, 1), (None, 0)), ((None, 2), (None, 1)), ((None, 2), (None, 0))]
    edges += [((99, 200), (99, 199)), ((99, 200), (99, 7))] + [((98, i), (98, (i + 1) % 3)) for i in range(3)] + [((98, 3), (98, 2)), ((98, 4), (98, 3)), ((98, 4), (98, 0))]
    key = "struct<conv_id:long,call_id:long>"
    frames = spark.createDataFrame(edges + edges[:5], f"key {key}, on {key}"), spark.createDataFrame([(c,) for c in calls], f"key {key}")
    got = {tuple(r["key"]): r["level"] for r in tool_calls.levels(*frames).collect()}
    assert got == levels_truth(edges, calls) and got[99, 399] == 399 and got[98, 4] is None and sum(v is None for v in got.values()) > 5
    assert len(tables) <= 34
    assert {r["level"] for r in tool_calls.levels(frames[0].limit(0), frames[1]).collect()} == {0} and tool_calls.levels(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_tool_calls_are_hash_joined(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "x")]
    made = tool_calls.link_calls(*tool_calls.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_templates_are_found_by_their_rare_words(spark):
    """Without posted words no template is found, but base phrases are; with all that the bound asks for, what brute force finds."""
    texts = [(k, f"words before {t} and after") for k, (_, t, _) in enumerate(licenses.TEXTS)] + [(900 + i, s) for i, s in enumerate(sentences(77, 30, 20))] + [(999, "the MIT License")]
    docs = table(spark, texts)
    hits = lambda rare: sorted((r["doc_id"], h["template"], h["start"]) for r in licenses.license_hits(docs, licenses.TEXTS, rare=rare).select("doc_id", "hits").collect() for h in r["hits"])
    none, whole = hits(0), hits(None)
    assert none and all(template < len(licenses.BASE) for _, template, _ in none) and set(none) < set(whole)
    assert {d for d, template, _ in whole if template >= len(licenses.BASE)} >= set(range(len(licenses.TEXTS)))


def test_posted_words_are_enough():
    """However the missed words of a hit are chosen, as many posted places as promised are left."""
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))]
        idf = {w: rng.choice([0.0, 0.5, 1.0, 4.0, 7.0]) for w in words}
        template = {"words": words, "weights": [max(idf[w], 0.01) for w in words], "least": rng.choice([0.75, 0.999999])}
        taken, votes = licenses.posted(template, idf)
        missed = (1 - template["least"]) * sum(template["weights"])
        # The fewest posted places that are left: all missed weight is spent on the heaviest that fit, by every choice of places.
        places = [w for x, w in zip(words, template["weights"]) if x in taken]
        fewest = min(len(places) - n for n in range(len(places) + 1) for lost in itertools.combinations(places, n) if sum(lost) <= missed)
        assert fewest >= votes


def test_ranges_of_many_short_texts_are_cut(spark):
    """10^5 empty texts and 20 000 copies of one row beside long texts: by bytes they are little, by rows nearly all."""
    long = sentences(40, 400, 60)
    rows = [(i, t * 20) for i, t in enumerate(long)]
    short = spark.range(1000, 101_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).unionByName(spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(short).withColumn("tie", F.lit("x"))
    seen = docs.select(F.xxhash64("text").alias("high"), F.col("doc_id").alias("low"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), (F.octet_length("text") + 1).cast("long").alias("size")).cache()
    _, sums = sharding.ranged(seen, ranges=128, sample=4096)
    n = [r["rows"] for r in sums.collect()]
    assert sum(n) == 120_400 and max(n) <= 4 * 120_400 / 128 and len(n) <= 1280
    got = sharding.shards_by_bytes(docs, shards=8, ranges=128, sample=4096)
    by = {r["shard"]: r for r in got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()}
    share = sum(r["bytes"] for r in by.values()) / 8
    assert all(r["n"] == r["slots"] == r["last"] + 1 and abs(r["bytes"] - share) < 0.06 * share for r in by.values())
    # Equal texts still share a shard.
    assert got.filter("size = 1").select("shard").distinct().count() == 1 and got.filter("size = 5").select("shard").distinct().count() == 1
