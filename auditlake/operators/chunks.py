"""Cutting files into chunks.

files (project_id, path, content), spans (project_id, file_path, node_type, start_offset, end_offset, start_line,
end_line; offsets in code points): where declarations are comes from the caller. Chunks: project_id, file_path,
seq, content, start_line, end_line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SIZE, OVERLAP, LEAST, MOST, TINY = 1600, 200, 200, 400, 20


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(content: Column, start_line: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (at, content, start_line, end_line): windows of `size` characters, each beginning `overlap` before the last one's end; blank ones are left out."""
    step = size - overlap
    if overlap > step:
        raise ValueError("an overlap of more than half a piece")
    count = F.greatest(F.lit(1), F.ceil((F.length(content) - overlap) / step)).cast("int")
    breaks = lambda body: F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))

    # The text is read once, as blocks of a step each; a piece is a block and the beginning of the next one.
    def cut(blocks: Column) -> Column:
        firsts = F.aggregate(blocks, F.array(start_line.cast("int")), lambda lines, b: F.concat(lines, F.array((F.element_at(lines, -1) + breaks(b)).cast("int"))))

        def piece(lines: Column, i: Column) -> Column:
            body, first = F.concat(F.get(blocks, i), F.coalesce(F.substring(F.get(blocks, i + 1), 1, overlap), F.lit(""))), F.get(lines, i)
            # Most pieces end inside a word, and then no white space need be looked for.
            trimmed = F.when(F.right(body, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(body, r"(?U)\s+$", "")).otherwise(body)
            return F.struct(i.alias("at"), trimmed.alias("content"), first.alias("start_line"), (first + text.line_count(body) - 1).cast("int").alias("end_line"))

        return once(firsts, lambda lines: F.transform(F.sequence(F.lit(0), count - 1), lambda i: piece(lines, i)))

    return F.filter(once(F.regexp_extract_all(content, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), cut), lambda p: p["content"] != "")


def split_text(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """project_id, file_path, seq, content, start_line, end_line of every file's pieces."""
    cut = files.filter(F.length("content") > 0).select("project_id", F.col("path").alias("file_path"), F.explode(pieces(F.col("content"), F.lit(1), size, overlap)).alias("p"))
    return cut.select("project_id", "file_path", F.col("p.at").alias("seq"), F.col("p.content").alias("content"), F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"))


SPANS = "project_id string, file_path string, node_type string, name string, start_offset int, end_offset int, start_line int, end_line int"
#: One declaration that an extractor finds: node_type, name, start_offset, end_offset (code points), start_line, end_line (from 1).
Span = tuple[str, "str | None", int, int, int, int]


def extracted_spans(files: DataFrame, extract: Callable[[str, str], Iterable[Span]]) -> DataFrame:
    """The spans that a caller's extractor finds: `extract(path, content)` for each file, in tasks, a batch of files at a time.

    Which languages it parses, and how, is the extractor's matter; what it returns is checked. A span that is no such tuple, lies outside its
    file, ends before it begins or has no type ends the job with an error that names the file. Null contents are not read.
    """

    def checked(path: str, content: str, span: Span) -> Span:
        try:
            kind, name, start, end, first, last = span
            fine = isinstance(kind, str) and (name is None or isinstance(name, str)) and all(type(x) is int for x in (start, end, first, last))
        except (TypeError, ValueError):
            fine = False
        if not fine or not (kind and 0 <= start <= end <= len(content) and 1 <= first <= last <= content.count("\n") + 1):
            raise ValueError(f"the extractor's span {span!r} does not fit {path}")
        return span

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for f in frames:
            rows = [(project, path, *checked(path, content, s)) for project, path, content in f.itertuples(index=False) for s in extract(path, content)]
            yield pd.DataFrame(rows, columns=names)

    return files.filter("content IS NOT NULL").select(F.col("project_id").cast("string").alias("project_id"), "path", "content").mapInPandas(run, SPANS)


def chunk_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """A chunk per declaration, in order: large ones split, tiny expressions left out; files without spans whole or split; blank files give none."""
    files = files.filter(F.col("content").rlike(r"(?U)\S"))
    spans = spans.dropDuplicates(["project_id", "file_path", "start_offset", "end_offset", "node_type"])
    joined = files.withColumnRenamed("path", "file_path").hint("merge").join(spans.hint("merge"), ["project_id", "file_path"], "left")
    declared = F.col("start_offset").isNotNull()
    body = F.when(declared, F.regexp_replace(F.substr("content", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")), r"(?U)^\s+|\s+$", "")).otherwise(F.col("content"))
    cut = joined.select("project_id", "file_path", "node_type", F.coalesce("start_offset", F.lit(0)).alias("offset"), body.alias("body"), F.when(declared, F.col("start_line")).otherwise(1).alias("first"), F.when(declared, F.col("end_line")).otherwise(text.line_count(F.col("content"))).alias("last"))
    tokens = text.est_tokens(F.col("body"))
    cut = cut.filter((F.col("body") != "") & ~((tokens < TINY) & (F.coalesce("node_type", F.lit("")) == "expression_statement")))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("body").alias("content"), F.col("first").cast("int").alias("start_line"), F.col("last").cast("int").alias("end_line")))
    out = cut.select("project_id", "file_path", "offset", F.explode(F.when(tokens > MOST, pieces(F.col("body"), F.col("first"))).otherwise(whole)).alias("p"))
    return out.select("project_id", "file_path", F.struct("offset", F.col("p.at").alias("at")).alias("seq"), F.col("p.content").alias("content"), F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"))


def tokens_of(length: int) -> int:
    """`text.est_tokens` of a text of that many characters."""
    return max(1, -(-length // 4))


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by file and place; only the open chunk is carried from one to the next, across the batches."""
    key, at, last = None, 0, None  # the open chunk: content, start_line, end_line
    for b in batches:
        out: list[tuple] = []
        for project, path, content, start, end in zip(*(b[c].to_pylist() for c in ("project_id", "file_path", "content", "start_line", "end_line")), strict=True):
            if last is not None and key == (project, path) and tokens_of(len(last[0])) < LEAST and tokens_of(len(last[0]) + 2 + len(content)) <= MOST:
                last = (f"{last[0]}\n\n{content}", last[1], end)
                continue
            if last is not None:
                out.append((*key, at, *last))
            at, key, last = (at + 1 if key == (project, path) else 0), (project, path), (content, start, end)
        if out:
            yield row_batch(out, b.schema)
        schema = b.schema
    if last is not None:
        yield row_batch([(*key, at, *last)], schema)


def row_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field("project_id").type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["project_id", "file_path", "seq", "content", "start_line", "end_line"])


def merge_small(chunks: DataFrame) -> DataFrame:
    """Neighbours of a file joined while the first is small and both together are not large: a fold over the file's chunks in order.

    A file's chunks are read in turn by one task, in time linear in their number; of them only the open one, of `MOST` tokens or
    one chunk at most, is held. A null line number stays null; a file without chunks has no rows.
    """
    rows = chunks.select("project_id", "file_path", "seq", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content")
    ordered = rows.repartition("project_id", "file_path").sortWithinPartitions("project_id", "file_path", "seq", "start_line", "end_line", "content")
    return ordered.mapInArrow(folded, f"project_id {dict(chunks.dtypes)['project_id']}, file_path string, seq int, content string, start_line int, end_line int")


def chunk_corpus(files: DataFrame, spans: DataFrame) -> DataFrame:
    return merge_small(chunk_spans(files, spans))


def function_sizes(spans: DataFrame) -> DataFrame:
    """project_id, file_path, name, lines: a component (capital name in a markup file) ends at its last markup return (`logic_end_line`)."""
    component = F.col("file_path").rlike(r"(?i)\.[jt]sx$") & F.col("name").rlike("^[A-Z]") & F.col("logic_end_line").isNotNull()
    end = F.when(component, F.col("logic_end_line")).otherwise(F.col("end_line"))
    return spans.select("project_id", "file_path", F.coalesce("name", F.lit("anonymous")).alias("name"), (end - F.col("start_line") + 1).alias("lines"))
