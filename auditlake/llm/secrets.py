"""Secret scans with a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived: every run of literals that a match must
hold gives its trigrams, and alternatives give alternatives. Each task indexes its texts block by block: the
posting of a trigram is the set of the block's texts that hold it, in lower case. Intersecting postings by the
queries leaves few candidates, which the expressions verify on the whole text; a rule without mandatory
trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: kind, expression, flags, group whose length counts, least length. The first three are the base rules.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, 1),
    ("hub", r"gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 0, 15),
    ("cloud", r"AIza[0-9A-Za-z_-]+", 0, 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, 40),
]
BASE = ("assign", "access", "hex")
#: Bytes of text in a block of the index, and alternatives that a literal run may have.
BLOCK, ALTERNATIVES = 4 << 20, 64
#: Bytes whose trigrams are looked up at a time.
WINDOW = 1 << 20


def strings_of(items) -> tuple[set[str] | None, list[set[str]]]:
    """The strings that a parsed expression matches, if they are few; else None. And sets of which a match must hold one string each."""
    runs: list[set[str]] = []
    now: set[str] | None = {""}

    def close() -> None:
        nonlocal now
        if now:
            runs.append(now)
        now = {""}

    broken = False
    for op, arg in items:
        few: set[str] | None = None
        if op is kinds.LITERAL:
            few = {chr(arg)}
        elif op is kinds.IN and all(o in (kinds.LITERAL, kinds.RANGE) for o, _ in arg):
            chars = {chr(c) for o, a in arg for c in ([a] if o is kinds.LITERAL else range(a[0], min(a[1], a[0] + ALTERNATIVES) + 1))}
            few = chars if len(chars) <= 8 else None
        elif op is kinds.SUBPATTERN:
            few, inner = strings_of(arg[3])
            runs += inner if few is None else []
        elif op is kinds.BRANCH:
            each = [strings_of(x)[0] for x in arg[1]]
            few = set().union(*each) if all(x is not None for x in each) else None
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, inner = arg
            some, must = strings_of(inner)
            if some is not None and high <= 2:
                few, power = set(), {""}
                for n in range(int(high) + 1):
                    few |= power if n >= low else set()
                    power = {a + b for a in power for b in some}
            elif low > 0:
                runs += [*must, *([some] if some else [])]
        elif op is kinds.AT:
            few = {""}
        if few is not None and len(now) * len(few) <= ALTERNATIVES:
            now = {a + b for a in now for b in few}
        else:
            broken = True
            close()
            if few is not None:
                now = few
    if not broken:
        return now, runs
    close()
    return None, runs


def trigram_query(pattern: str, flags: int = 0) -> list[list[set[bytes]]]:
    """All of these must hold, each as one of its alternatives, each of which is a set of trigrams; nothing: no trigram is mandatory."""
    whole, runs = strings_of(parser.parse(pattern, flags))
    query = []
    for run in [*runs, *([whole] if whole else [])]:
        found = [s.lower().encode() for s in run]
        if all(len(s) > 2 for s in found):
            query.append(sorted(({s[i : i + 3] for i in range(len(s) - 2)} for s in found), key=sorted))
    return query


class Index:
    """Trigram queries of all rules, answered for a block of texts at a time."""

    def __init__(self, rules: list):
        self.queries = [trigram_query(pattern, flags) for _, pattern, flags, _, _ in rules]
        self.grams = sorted({g for q in self.queries for alternatives in q for grams in alternatives for g in grams})
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def candidates(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """For each rule a mask over the texts; None where the rule scans them all."""
        whole = np.frombuffer(b"\xff".join(texts).lower() + b"\xff\xff", np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        postings = np.zeros((len(self.grams) + 1, len(texts)), bool)
        # Of a very long text the trigrams are read a window at a time.
        for begin in range(0, len(whole) - 2, WINDOW):
            buf = whole[begin : begin + WINDOW + 2].astype(np.uint32)
            ids = self.table[buf[:-2] << 16 | buf[1:-1] << 8 | buf[2:]]
            at = np.flatnonzero(ids)
            postings[ids[at], np.searchsorted(starts, at + begin, side="right") - 1] = True
        masks: list[np.ndarray | None] = []
        for query in self.queries:
            mask = None
            for alternatives in query:
                some = np.zeros(len(texts), bool)
                for grams in alternatives:
                    some |= np.logical_and.reduce([postings[self.number[g] + 1] for g in grams])
                mask = some if mask is None else mask & some
            masks.append(mask)
        return masks


def scanner(rules: list):
    """doc_id and text to doc_id and the spans of each rule, as one list of (rule, start, end) in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        # A run of at least n characters of one class, and the runs of that class with n or more: the same spans.
        compiled = [re.compile(p[:-1] + f"{{{least},}}" if group == 0 and re.fullmatch(r"\[[^\]]*\]\+", p) else p, flags) for _, p, flags, group, least in rules]

        def block(ids: list, texts: list[str], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, mask in enumerate(index.candidates(raw)):
                group, least = rules[k][3:]
                for i in range(len(texts)) if mask is None else np.flatnonzero(mask).tolist():
                    spans[i] += [(m.start(), k, m.end()) for m in compiled[k].finditer(texts[i]) if len(m[group]) >= least]
            rows = [[f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "found"])

        for batch in batches:
            ids, texts, raw, held = [], [], [], 0
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                raw.append(texts[-1].encode("utf-8", "surrogatepass"))
                held += len(raw[-1])
                if held > BLOCK:
                    yield from block(ids, texts, raw)
                    ids, texts, raw, held = [], [], [], 0
            if ids:
                yield from block(ids, texts, raw)

    return scan


def secret_spans(docs: DataFrame, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and `found`, its spans as kind:start:end by start and then rule; code points, end exclusive.

    Matches of a rule are leftmost and do not overlap; those of too few characters are dropped. Matches of different
    rules may overlap. Null and empty texts have no spans; repeated rows have equal ones. Other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanner(rules), "doc_id long, found array<string>")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s.startswith(kind + ":"))).cast("long")
    base = F.filter("found", lambda s: F.substring_index(s, ":", 1).isin(*BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("found", ",").alias("spans"))


def op8_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op8_secrets` that SQL can express."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


#: Names in either case, without the letters that only a Unicode folding would add.
NAMES_SQL = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
OP8_COUNTS_SQL = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '({NAMES_SQL})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents
"""
