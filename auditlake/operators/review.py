"""Reviews by a model: the sample it sees, and what of its claims the code bears out.

chunks (project_id, file_path, content, start_line, end_line); claims (project_id, ord, category, severity, title,
description, file_path, quote).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from .graph import kept
from .rules import top_n

MAX_CHUNKS, MAX_CHARS, MAX_ISSUES = 24, 19_000, 10
MAX_TITLE, MAX_DESCRIPTION = 200, 1000


def rank_chunks_in_file(chunks: DataFrame) -> DataFrame:
    """`turn`: a file's chunks by risk, then line, then their order in it (`seq`, where it is known); `risk`, and `chars`, what a chunk takes in a request."""
    scored = chunks.withColumns({"risk": text.risk_score(F.col("content")), "chars": text.snippet_chars(F.col("content"), F.col("file_path"))})
    return scored.withColumn("turn", F.row_number().over(Window.partitionBy("project_id", "file_path").orderBy(F.desc("risk"), F.coalesce("start_line", F.lit(0)), *[c for c in ("seq", "content") if c in chunks.columns])))


def rank_files(ranked: DataFrame) -> DataFrame:
    """project_id, file_path, level, file_risk, file_rank: risky files first, server logic first, the riskiest first, then by path."""
    files = ranked.filter("turn = 1").select("project_id", "file_path", F.col("risk").alias("file_risk"), (F.when(F.col("risk") > 0, 0).otherwise(4) + paths.path_priority(F.col("file_path"))).alias("level"))
    return files.withColumn("file_rank", F.row_number().over(Window.partitionBy("project_id").orderBy("level", F.desc("file_risk"), F.collate("file_path", "UNICODE"), "file_path")))


def interleave_dirs(files: DataFrame) -> DataFrame:
    """`place`: inside each level one file of every directory in turn, directories by their first file."""
    own = Window.partitionBy("project_id", "level", "dir")
    turned = files.withColumn("dir", paths.dirname(F.col("file_path"))).withColumns({"dir_turn": F.row_number().over(own.orderBy("file_rank")), "dir_first": F.min("file_rank").over(own)})
    return turned.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("level", "dir_turn", "dir_first"))).drop("dir", "dir_turn", "dir_first")


def round_robin(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """`queue`: the first chunk of every file, then the second of each, and so on.

    A turn has at most one chunk of each file and is numbered by itself; it begins after the chunks of the turns before.
    """
    joined = ranked.join(placed.select("project_id", "file_path", "place").hint("merge"), ["project_id", "file_path"])
    turns = ranked.groupBy("project_id", "turn").agg(F.count("*").alias("_n"))
    before = turns.select("project_id", "turn", (F.sum("_n").over(Window.partitionBy("project_id").orderBy("turn")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("project_id", "turn").orderBy("place"))
    return joined.withColumn("_own", own).join(before.hint("merge"), ["project_id", "turn"]).withColumn("queue", (F.col("_before") + F.col("_own")).cast("int")).drop("_own", "_before")


def fill_budget(queue: DataFrame, max_n: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """project_id, queue of the chunks taken in queue order while they fit; one that does not is passed over.

    queue: project_id, queue, chars. Whether a chunk fits depends on those taken before, so this is a fold over a
    project's chunk sizes in order. Of chunks of one size no more than `max_n` can be taken, and those come first, so
    the fold has at most `max_n` entries for each size, however large the project.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, c: Column) -> Column:
        fits = (F.size(state["taken"]) < max_n) & (state["used"] + c["chars"] <= max_chars)
        return F.struct(F.when(fits, state["used"] + c["chars"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(c["queue"]))).otherwise(state["taken"]).alias("taken"))

    order = F.array_sort(F.collect_list(F.struct("queue", "chars")))
    first = top_n(queue.select("project_id", "queue", "chars"), ["project_id", "chars"], [F.col("queue")], max_n)
    return first.groupBy("project_id").agg(order.alias("o")).select("project_id", F.explode(F.aggregate("o", start, step, lambda s: s["taken"])).alias("queue"))


def review_sample(chunks: DataFrame, max_n: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The chunks a reviewer sees: tests only where a project has nothing else. `queue` is their order among the candidates.

    Chunks are scored once and written out. The order is by turn and then by the files' places, which are found on one row a file. Of
    chunks of one size only the first `max_n` can be taken, so no more of each size than that are put in order and numbered;
    the texts of those taken are read by project, file and turn.
    """
    is_test = paths.is_test_file(F.col("file_path"))
    with_code = chunks.filter(~is_test).select("project_id").distinct()
    chosen = chunks.filter(~is_test).unionByName(chunks.filter(is_test).join(with_code.hint("merge"), "project_id", "left_anti"))
    ranked = kept(rank_chunks_in_file(chosen))
    thin = ranked.select("project_id", "file_path", "turn", "risk", "chars")
    placed = thin.hint("merge").join(interleave_dirs(rank_files(thin)).select("project_id", "file_path", "place").hint("merge"), ["project_id", "file_path"])
    candidates = top_n(placed, ["project_id", "chars"], [F.col("turn"), F.col("place")], max_n, "_n").drop("_n")
    queue = kept(candidates.withColumn("queue", F.row_number().over(Window.partitionBy("project_id").orderBy("turn", "place"))).select("project_id", "file_path", "turn", "chars", "queue"))
    taken = queue.hint("merge").join(fill_budget(queue, max_n, max_chars).hint("merge"), ["project_id", "queue"]).select("project_id", "file_path", "turn", "queue")
    return ranked.hint("merge").join(kept(taken).hint("merge"), ["project_id", "file_path", "turn"])


def sample_files(sample: DataFrame) -> DataFrame:
    return sample.select("project_id", "file_path").distinct()


def order_by_path(df: DataFrame, path: str = "file_path", line: str = "start_line") -> DataFrame:
    return df.orderBy(F.collate(path, "UNICODE"), path, F.coalesce(line, F.lit(0)))


def locate(content: Column, start_line: Column, quote: Column) -> Column:
    """start_line, end_line, snippet: from the first line that holds the quote's first line or is held by it."""
    trimmed = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    wanted = text.collapse_ws(F.element_at(F.split(trimmed, "\n", -1), 1))
    near = F.transform(F.split(content, "\n", -1), lambda line: (text.collapse_ws(line) != "") & (text.collapse_ws(line).contains(wanted) | wanted.contains(text.collapse_ws(line))))
    at = F.greatest(F.array_position(near, True) - 1, F.lit(0)).cast("int")
    first = F.coalesce(start_line, F.lit(1)) + at
    return F.struct(first.alias("start_line"), (first + text.line_count(trimmed) - 1).alias("end_line"), F.substring(trimmed, 1, 500).alias("snippet"))


def verify_evidence(claims: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with `evidence`, dropped claims).

    A claim about a file stays when a chunk of that file holds its quote, white space aside; the first such chunk by
    line gives the evidence. A claim without a file stays, at most of medium severity.
    """
    claims = claims.withColumns({"file_path": text.norm_path(F.col("file_path")), "_wanted": F.nullif(text.collapse_ws(F.coalesce("quote", F.lit(""))), F.lit(""))})
    chunk = chunks.select("project_id", "file_path", F.col("content").alias("_content"), F.col("start_line").alias("_start"))
    held = claims.filter("file_path IS NOT NULL AND _wanted IS NOT NULL").join(chunk, ["project_id", "file_path"]).filter(text.collapse_ws(F.col("_content")).contains(F.col("_wanted")))
    first = top_n(held, ["project_id", "ord"], [F.col("_start").asc_nulls_first(), F.col("_content")], 1)
    cols = [c for c in claims.columns if c not in ("quote", "_wanted")]
    found = first.select(*cols, locate(F.col("_content"), F.col("_start"), F.col("quote")).alias("evidence"))
    wide = claims.filter("file_path IS NULL").withColumn("severity", F.when(F.col("severity").isin("critical", "high"), "medium").otherwise(F.col("severity")))
    findings = found.unionByName(wide.select(*cols, F.lit(None).cast(found.schema["evidence"].dataType).alias("evidence")))
    dropped = claims.filter("file_path IS NOT NULL").join(found.select("project_id", "ord"), ["project_id", "ord"], "left_anti").drop("_wanted")
    return findings, dropped


# The sentences around the data of a request.
EXCERPT, NO_SOURCES, NAME_CHARS = "an excerpt: the file goes on before and after it", "(No relevant sources were retrieved.)", 100


def assemble_prompts(sample: DataFrame, projects: DataFrame, instructions: str) -> DataFrame:
    """project_id, prompt, tokens: the project's snippets in path order, each between data marks. projects: project_id, name, framework, boundary."""
    # A sample is MAX_CHUNKS snippets a project at most.
    content = text.cut(F.col("content"), text.CHUNK_CHARS, "\n" + text.CUT_MARK).alias("content")
    order = F.array_sort(F.collect_list(F.struct("file_path", F.coalesce("start_line", F.lit(0)).alias("start_line"), "end_line", content)))
    grouped = sample.groupBy("project_id").agg(order.alias("o")).hint("merge").join(projects.hint("merge"), "project_id")

    def block(c: Column, i: Column) -> Column:
        header = F.concat(F.lit("Chunk "), (i + 1).cast("string"), F.lit(". File: "), c["file_path"], F.lit(" ("), text.line_range(c["start_line"], c["end_line"]), F.lit(f", {EXCERPT})"))
        return text.data_block(header, c["content"], F.col("boundary"))

    name = F.concat(F.lit("Project: "), F.substring(F.coalesce("name", F.lit("")), 1, NAME_CHARS))
    framework = F.concat(F.lit("Framework: "), F.coalesce("framework", F.lit("Unknown")))
    made = grouped.select("project_id", F.concat_ws("\n", name, framework, F.lit(""), F.lit("Code snippets:"), F.array_join(F.transform("o", block), "\n\n")).alias("prompt"))
    return made.withColumn("tokens", text.est_request_tokens(F.lit(instructions), F.col("prompt")))


def chat_prompts(questions: DataFrame, retrieved: DataFrame, projects: DataFrame, role: str, rules: list[str]) -> DataFrame:
    """project_id, query_id, prompt, sources of every question: the role, the rules and the retrieved chunks in order of rank, each between data marks.

    questions (project_id, query_id), retrieved as `vectors.retrieve` gives it, projects (project_id, name, framework, boundary).
    `sources` are what an answer shows: file_path, start_line, end_line, score. A question without chunks has a sentence in their place.
    """
    # Of a question the first k chunks come, which are few.
    found = retrieved.groupBy("project_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "start_line", "end_line", "score", "content"))).alias("o"))
    joined = questions.select("project_id", "query_id").hint("merge").join(found.hint("merge"), ["project_id", "query_id"], "left").hint("merge").join(projects.hint("merge"), "project_id")

    def block(c: Column, i: Column) -> Column:
        header = F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(". File: "), c["file_path"], F.lit(" ("), text.line_range(c["start_line"], c["end_line"]), F.lit(")"))
        return text.data_block(header, c["content"], F.col("boundary"))

    context = F.coalesce(F.nullif(F.array_join(F.transform("o", block), "\n\n"), F.lit("")), F.lit(NO_SOURCES))
    head = [F.lit(role), F.concat(F.lit("Project: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("Detected framework: "), F.coalesce("framework", F.lit("Unknown")))]
    said = [F.lit(""), F.lit("Rules:"), *[F.replace(F.lit(f"- {r}"), F.lit("{boundary}"), F.col("boundary")) for r in rules], F.lit(""), F.lit("Retrieved code sources:")]
    sources = F.coalesce(F.transform("o", lambda c: F.struct(c["file_path"].alias("file_path"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), F.coalesce(c["score"], F.lit(0.0)).alias("score"))), F.array().cast("array<struct<file_path:string,start_line:int,end_line:int,score:double>>"))
    return joined.select("project_id", "query_id", F.concat_ws("\n", *head, *said, context).alias("prompt"), sources.alias("sources"))


def review_requests(projects: DataFrame, chunks: DataFrame, instructions: str, most_tokens: int = 7500) -> DataFrame:
    """Review requests of all projects; `fits` tells whether one keeps to the token limit."""
    return assemble_prompts(review_sample(chunks), projects, instructions).withColumn("fits", F.col("tokens") <= most_tokens)


def ingest_reviews(claims: DataFrame, sample: DataFrame, most: int = MAX_ISSUES) -> tuple[DataFrame, DataFrame]:
    """(findings: of each project the first ten claims, in the reviewer's order, whose evidence is in the sample, cut to length; project_id, dropped: how many had none)."""
    findings, dropped = verify_evidence(claims, sample)
    first = top_n(findings, ["project_id"], [F.col("ord")], most, "_n").drop("_n")
    short = first.withColumns({"title": text.cut(F.col("title"), MAX_TITLE), "description": text.cut(F.col("description"), MAX_DESCRIPTION)})
    return short, dropped.groupBy("project_id").agg(F.count("*").alias("dropped"))


def reuse_reviews(inputs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Inputs (project_id, input_hash) with the stored review of the identical input, if any."""
    return inputs.join(reviews, ["project_id", "input_hash"], "left")


def review_outcome(df: DataFrame) -> DataFrame:
    """`outcome` from the flags stored_hash, input_hash, enabled, budget_left, available, in this order."""
    return df.withColumn("outcome", F.when(F.col("stored_hash") == F.col("input_hash"), "reuse").when(~F.coalesce("enabled", F.lit(True)), "disabled").when(~F.col("budget_left"), "budget").when(~F.col("available"), "unavailable").otherwise("review"))


def last_user_text(messages: DataFrame) -> DataFrame:
    """conv_id, text of the last user turn that is not blank."""
    return messages.filter((F.col("role") == "user") & F.col("text").rlike(r"(?U)\S")).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
