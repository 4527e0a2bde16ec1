"""Exact deduplication by Patricia tries.

Every task first inserts its own texts into a trie, so a group of copies leaves it as one row however
many rows it has. Those rows are dealt by length and content hash; the owning task inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the smallest identifier and the number of
copies. A trie that outgrows its budget gives its largest subtree away: those strings leave as rows and
are dealt again by their subtree, so the shuffle, and not a local file, carries the spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, read, text_of

#: Bytes that one trie may take.
BUDGET = 96 << 20
#: What a node takes besides its label.
NODE = 200
SCHEMA = "key binary, sha string, keep_id long, group_size long, subtree string"
ARROW = pa.schema([("key", pa.binary()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("subtree", pa.string())])


class Node:
    __slots__ = ("label", "children", "end", "given")

    def __init__(self, label: bytes):
        self.label, self.children, self.end, self.given = label, {}, None, False


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices compare faster than single bytes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Trie:
    """A compressed radix trie of byte strings; a terminal node has [smallest id, copies, hash].

    `size` counts a label's bytes and NODE for every node, whether strings come or a subtree goes.
    """

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def add(self, key: bytes, sha: str, doc_id: int | None, copies: int) -> str | None:
        """Inserts `key`; where its subtree was given away, returns that subtree's name instead."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + NODE
            elif not key.startswith(child.label, at):
                k = shared(child.label, key[at : at + len(child.label)])
                if child.given:
                    return key[: at + k].hex()[:64] + f"/{at + k}"
                above = Node(child.label[:k])
                child.label = child.label[k:]
                above.children[child.label[0]] = child
                node.children[key[at]] = child = above
                self.size += NODE
            at += len(child.label)
            node = child
            if node.given:
                return key[:at].hex()[:64] + f"/{at}"
        if node.end is None:
            node.end = [doc_id, copies, sha]
        else:
            known = node.end
            known[0] = doc_id if known[0] is None else known[0] if doc_id is None else min(known[0], doc_id)
            known[1] += copies
        return None

    def strings(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """All strings at and below a node, with their terminals."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, before = stack.pop()
            if at.end is not None:
                yield before, at.end
            stack += [(x, before + x.label) for x in at.children.values()]

    def give(self) -> tuple[str, list[tuple[bytes, list]]]:
        """Gives away the largest subtree below the first branching; nothing if there is no branching."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.end is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        live = [(x, list(self.strings(x, prefix + x.label))) for x in node.children.values() if not x.given]
        if len(node.children) + (node.end is not None) < 2 or not live:
            return "", []
        child, gone = max(live, key=lambda pair: sum(len(k) for k, _ in pair[1]))
        below = list(child.children.values())
        for x in below:
            below += x.children.values()
            self.size -= len(x.label) + NODE
        # Of its label one byte stays, so that the trie gets as small as what it keeps; all that begins alike follows it.
        self.size -= len(child.label) - 1
        child.label, child.children, child.end, child.given = child.label[:1], {}, None, True
        at = len(prefix) + len(child.label)
        return (prefix + child.label).hex()[:64] + f"/{at}", gone


def batches_of(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0] or b"") + 100
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)


def combiner(budget: int):
    """Map side: each task's copies as one row each; over the budget, the trie is emptied and begun anew."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie()
        for b in batches:
            for i in range(b.num_rows):
                trie.add(b["key"][i].as_py(), b["sha"][i].as_py(), b["keep_id"][i].as_py(), 1)
                if trie.size > budget:
                    yield from ((k, end[2], end[0], end[1], None) for k, end in trie.strings())
                    trie = Trie()
        yield from ((k, end[2], end[0], end[1], None) for k, end in trie.strings())

    return lambda batches: batches_of(rows(batches))


def owner(budget: int):
    """Reduce side: one row per distinct string, without the string; spilled strings keep it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie()
        for b in batches:
            for i in range(b.num_rows):
                key, sha, doc_id, copies = (b[c][i].as_py() for c in ("key", "sha", "keep_id", "group_size"))
                subtree = trie.add(key, sha, doc_id, copies)
                if subtree is not None:
                    yield key, sha, doc_id, copies, subtree
                elif trie.size > budget:
                    subtree, gone = trie.give()
                    yield from ((k, end[2], end[0], end[1], subtree) for k, end in gone)
        yield from ((None, end[2], end[0], end[1], None) for _, end in trie.strings())

    return lambda batches: batches_of(rows(batches))


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (text in UTF-8 with each run of white space as one space), sha (its SHA-256)."""
    text = F.regexp_replace(text_of(text_col), SPACES, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("key")).select("doc_id", F.col("key").cast("binary").alias("key"), F.sha2("key", 256).alias("sha"))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """sha, keep_id, group_size of each distinct text."""
    rest = normalised(docs, id_col, text_col).select("key", "sha", F.col("doc_id").alias("keep_id")).mapInArrow(combiner(budget), SCHEMA)
    rest = rest.repartition(F.octet_length("key"), F.xxhash64("sha"))
    parts = []
    while True:
        out = cut(rest.mapInArrow(owner(budget), SCHEMA))
        parts.append(out.filter("subtree IS NULL").select("sha", "keep_id", "group_size"))
        spilled = out.filter("subtree IS NOT NULL")
        if spilled.isEmpty():
            break
        # Equal strings have one subtree name at a given depth, or a deeper one where it was split later: a last grouping below joins them.
        rest = spilled.repartition(F.octet_length("key"), F.substring("sha", 1, 8), "subtree")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole if len(parts) == 1 else whole.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space. A null text
    counts as empty, and empty texts are equal to each other. Of equal texts the smallest id stays; ids that
    are null stay only where the group has no other. Rows that repeat an id are rows of their own, and each of
    them that has the kept id is kept. Other columns of `docs` are not read, whatever their names.
    """
    found = owners(docs, id_col, text_col, budget)
    return (
        normalised(docs, id_col, text_col).select("doc_id", "sha").hint("merge").join(found.hint("merge"), "sha")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
