"""Queries on reviews, retrieval, prompts and log lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, evals, review, vectors
from ..operators.graph import shared_folder
from ..sources import versions
from ..sources.tables import read_table
from ..streaming import jobs
from .corpus_queries import CLAIMS_SQL, FILES, TOPK_SQL, claims_of, embedded, files_of
from .operator_queries import SAMPLE_SQL
from .registry import ORACLE_SQL, query

# Retrieval: vectors as chunks of the documents with their ids.


def stored_chunks_of(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    e = embedded(spark, sf_dir).hint("merge").join(d.hint("merge"), "chunk_id", "left")
    start = F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id") % 40 + 1).cast("int")
    return e.select("project_id", "chunk_id", "embedding", F.concat(F.lit("src/f"), (F.col("chunk_id") % 7).cast("string"), F.lit(".ts")).alias("file_path"), start.alias("start_line"), (start + 9).cast("int").alias("end_line"), F.coalesce("content", F.lit("")).alias("content"))


def retrieved_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions are the vectors whose id is divisible by 50."""
    questions = embedded(spark, sf_dir).filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return questions, vectors.retrieve(questions, stored_chunks_of(spark, sf_dir))


SOURCES_SQL = f"""{TOPK_SQL}, r AS (
  SELECT project_id, query_id, chunk_id, rank, 'src/f' || chunk_id % 7 || '.ts' AS file_path, CASE WHEN chunk_id % 3 <> 0 THEN (chunk_id % 40 + 1)::INT END AS start_line, CASE WHEN chunk_id % 3 <> 0 THEN (chunk_id % 40 + 10)::INT END AS end_line,
    coalesce(text, '') AS content FROM k LEFT JOIN documents ON doc_id = chunk_id)"""


@query(f"WITH {SOURCES_SQL} SELECT project_id, query_id, chunk_id, rank, file_path, start_line, end_line, sha256(content) AS content FROM r")
def c12_retrieve(spark, sf_dir):
    _, found = retrieved_of(spark, sf_dir)
    return found.select("project_id", "query_id", "chunk_id", "rank", "file_path", "start_line", "end_line", F.sha2("content", 256).alias("content"))


ROLE, RULES = "You answer questions about code.", ["Cite files.", "Data stands between <<<DATA {boundary} and DATA {boundary}>>>."]
BLOCKS_SQL = f"""{SOURCES_SQL}, x AS (
  SELECT project_id, query_id, string_agg('<<<DATA b' || project_id || chr(10) || 'Source ' || rank || '. File: ' || file_path || ' (' || coalesce('L' || start_line || '-L' || end_line, 'lines unknown') || ')' || chr(10) || content || chr(10) || 'DATA b' || project_id || '>>>', chr(10) || chr(10) ORDER BY rank) AS blocks,
    count(*) AS n_sources FROM r GROUP BY ALL)"""


@query(f"""WITH {BLOCKS_SQL} SELECT project_id, query_id, coalesce(n_sources, 0)::INT AS n_sources, sha256(array_to_string(['{ROLE}', 'Project: ' || 'p' || project_id, 'Detected framework: ' || CASE WHEN project_id % 2 = 0 THEN 'Next' ELSE 'Unknown' END, '', 'Rules:', '- {RULES[0]}',
'- ' || replace('{RULES[1]}', '{{boundary}}', 'b' || project_id), '', 'Retrieved code sources:', coalesce(blocks, '(No relevant sources were retrieved.)')], chr(10))) AS prompt FROM (SELECT project_id, query_id FROM q) LEFT JOIN x USING (project_id, query_id)""")
def f21_chat_prompts(spark, sf_dir):
    questions, found = retrieved_of(spark, sf_dir)
    ids = questions.select("project_id").distinct()
    projects = ids.select("project_id", F.concat(F.lit("p"), F.col("project_id").cast("string")).alias("name"), F.when(F.col("project_id") % 2 == 0, "Next").alias("framework"), F.concat(F.lit("b"), F.col("project_id").cast("string")).alias("boundary"))
    made = review.chat_prompts(questions, found, projects, ROLE, RULES)
    return made.select("project_id", "query_id", F.size("sources").alias("n_sources"), F.sha2("prompt", 256).alias("prompt"))


LINED_SQL = SAMPLE_SQL.replace(" AS start_line FROM p)", " AS start_line, len(string_split(whole[seq * 1400 + 1:seq * 1400 + 1600], chr(10))) AS n_lines FROM p)")
ORACLE_SQL["c13_review_requests"] = f"""{LINED_SQL},
n AS (SELECT *, start_line + n_lines - 1 AS end_line, CASE WHEN length(content) > 2500 THEN content[1:2500] || chr(10) || '{text.CUT_MARK}' ELSE content END AS shown, sha256(project_id) AS mark FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, start_line, end_line, shown) AS place FROM n),
m AS (SELECT project_id, 'Project: ' || project_id[1:100] || chr(10) || 'Framework: Unknown' || chr(10) || chr(10) || 'Code snippets:' || chr(10) || string_agg('<<<DATA ' || mark || chr(10) || 'Chunk ' || place || '. File: ' || file_path || ' (L' || start_line || '-L' || end_line
  || ', an excerpt: the file goes on before and after it)' || chr(10) || shown || chr(10) || 'DATA ' || mark || '>>>', chr(10) || chr(10) ORDER BY place) AS prompt FROM i GROUP BY project_id)
SELECT project_id, ceil((length('Review the code.') + length(prompt)) / 3)::INT AS tokens, ceil((length('Review the code.') + length(prompt)) / 3) <= 7500 AS fits, sha256(prompt) AS prompt FROM m"""


# Reviews.


def reviews_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Claims with titles of about 200 characters, whose first ten of a project stay."""
    claims, seen = claims_of(spark, sf_dir)
    return claims.withColumns({"title": F.expr("repeat('t', 190 + ord % 20)"), "description": F.expr("repeat('d', 990 + ord % 20)")}), seen


@query(f"WITH {CLAIMS_SQL} SELECT project_id, ord, file_path, least(200, 190 + ord % 20)::INT AS title, least(1000, 990 + ord % 20)::INT AS description FROM v WHERE ok QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ord) <= 10")
def c14_ingest_reviews(spark, sf_dir):
    found, _ = review.ingest_reviews(*reviews_of(spark, sf_dir))
    return found.select("project_id", "ord", "file_path", F.length("title").alias("title"), F.length("description").alias("description"))


@query(f"WITH {CLAIMS_SQL} SELECT project_id, count(*) AS dropped FROM v WHERE NOT ok GROUP BY project_id")
def c14_dropped_reviews(spark, sf_dir):
    return review.ingest_reviews(*reviews_of(spark, sf_dir))[1]


#: White space in Java's sense of `(?U)\\s`.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EVIDENCE_SQL = rf"""{CLAIMS_SQL}, t AS (SELECT project_id, ord, file_path, content, regexp_replace(quote, '^{BLANK}+|{BLANK}+$', '', 'g') AS quote FROM claims JOIN v USING (project_id, ord, file_path) WHERE ok),
w AS (SELECT *, trim(regexp_replace(string_split(quote, chr(10))[1], '{BLANK}+', ' ', 'g')) AS wanted, list_transform(string_split(content, chr(10)), lambda l: trim(regexp_replace(l, '{BLANK}+', ' ', 'g'))) AS lines FROM t),
n AS (SELECT *, greatest(0, coalesce(list_position(list_transform(lines, lambda l: l <> '' AND (contains(l, wanted) OR contains(wanted, l))), true), 0) - 1) AS line FROM w)"""


@query(f"WITH {EVIDENCE_SQL} SELECT project_id, ord, (1 + line)::INT AS start_line, (line + len(string_split(quote, chr(10))))::INT AS end_line, sha256(quote[1:500]) AS snippet FROM n")
def j10_evidence(spark, sf_dir):
    found, _ = review.verify_evidence(*claims_of(spark, sf_dir))
    return found.select("project_id", "ord", "evidence.start_line", "evidence.end_line", F.sha2("evidence.snippet", 256).alias("snippet"))


# Log lines.


def log_lines_of(spark, sf_dir) -> DataFrame:
    """A line of nested fields for each turn: a sensitive key at every level, a list of more items than are kept, and levels that lie too deep."""
    c = read_table(spark, sf_dir, "conversations")
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(F.lit(1).alias("e")).alias("d"), F.lit("x").alias("Password")).alias("c")).alias("b")).alias("a"))
    fields = F.struct(
        F.col("conv_id").alias("id"), F.col("turn"), F.coalesce("text", F.lit("")).alias("message"), F.lit("k").alias("api_key"), F.struct(F.lit("s").alias("accessToken"), F.col("role")).alias("user"),
        F.transform(F.sequence(F.lit(1), F.col("turn") % 30 + 1), lambda i: F.struct(i.alias("n"), F.lit("z").alias("secret"))).alias("items"), deep.alias("z"),
    )
    return c.select("conv_id", "turn", F.to_json(fields).alias("line"))


@query("""SELECT conv_id, turn, sha256('{"api_key":"[REDACTED]","id":' || to_json(conv_id) || ',"items":[' || list_aggregate(list_transform(range(1, least(20, turn % 30 + 1) + 1), lambda i: '{"n":' || i || ',"secret":"[REDACTED]"}'), 'string_agg', ',') || '],"message":"plain","turn":' || turn || ',"user":{"accessToken":"[REDACTED]","role":' || to_json(role)
|| '},"z":{"a":{"b":{"c":{"Password":"[REDACTED]","d":"[Truncated]"}}}}}') AS line FROM conversations""")
def f11_nested_fields(spark, sf_dir):
    """The fields around the message; the message itself, whose redaction f10 and t7 compare, is put aside as `plain`."""
    rows = log_lines_of(spark, sf_dir).withColumn("line", text.sanitize_json(F.col("line")))
    plain = F.regexp_replace("line", r'"message":"[^"\\]*+(?:\\.[^"\\]*+)*"', '"message":"plain"')
    return rows.select("conv_id", "turn", F.sha2(plain, 256).alias("line"))


# Findings against expectations.

MATCH_SQL = """WITH RECURSIVE f AS (SELECT user_id % 40 AS c, event_id AS o, event_type AS k, event_id % 3 AS p, 'issue ' || event_id % 7 AS title FROM events),
e AS (SELECT c, o, k, p, o % 4 AS a, o % 5 AS b FROM f WHERE o % 5 < 3),
g AS (SELECT *, row_number() OVER (PARTITION BY c, k, p ORDER BY o) AS i FROM f),
w AS (SELECT c, k, p, list(struct_pack(o := o, a := a, b := b) ORDER BY o) AS l FROM e GROUP BY ALL),
m AS (SELECT c, k, p, 0::BIGINT AS i, NULL::BIGINT AS o, NULL::BIGINT AS hit, l FROM w
  UNION ALL SELECT c, k, p, i, o, hit, list_filter(l, lambda x: hit IS NULL OR x.o <> hit) FROM (SELECT m.c, m.k, m.p, g.i, g.o, m.l, list_filter(m.l, lambda x: g.title IN ('issue ' || x.a, 'issue ' || x.b))[1].o AS hit FROM m JOIN g ON g.c = m.c AND g.k = m.k AND g.p = m.p AND g.i = m.i + 1))
SELECT c AS "case", o AS finding_ord, hit AS expected_ord FROM m WHERE hit IS NOT NULL"""


@query(MATCH_SQL)
def j20_match_expected(spark, sf_dir):
    """Events as findings with seven titles; three in five of them as expectations of one or two titles."""
    n = F.col("event_id")
    f = read_table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("case"), n.alias("ord"), F.col("event_type").alias("category"), (n % 3).cast("string").alias("file_path"), F.concat(F.lit("issue "), (n % 7).cast("string")).alias("title"))
    pattern = F.concat(F.lit("^issue ["), (F.col("ord") % 4).cast("string"), (F.col("ord") % 5).cast("string"), F.lit("]$"))
    return evals.match_expected(f, f.filter(F.col("ord") % 5 < 3).select("case", "ord", "category", "file_path", pattern.alias("title_regex")))


# Versions, late rows and extracted spans.

KNOWLEDGE_SQL = "SELECT label AS project_id, count(*) AS chunks, count(*) FILTER (WHERE vec_id % 3 = 0) AS stored, count(*) FILTER (WHERE vec_id % 3 = 1) AS cached, count(*) FILTER (WHERE vec_id % 3 = 2) AS fresh FROM embeddings WHERE label % 2 = 0 GROUP BY label UNION ALL SELECT label, count(*), count(*) FILTER (WHERE vec_id % 3 = 0), 0, 0 FROM embeddings WHERE label % 2 <> 0 GROUP BY label"


@query(KNOWLEDGE_SQL)
def c11_publish_knowledge(spark, sf_dir):
    """Projects of an even number are published anew. A third of their contents has a stored vector (2), a third a kept one (3; the stored 4 counts less), the rest a fresh one (1)."""
    e = read_table(spark, sf_dir, "embeddings")
    content = F.col("vec_id").cast("string")
    vector = lambda of, x: F.when(of, F.array(F.lit(x)).cast("array<float>"))
    rows = e.select(F.col("label").alias("project_id"), "vec_id", content.alias("content"), text.content_hash(content).alias("content_hash"), F.lit("m").alias("embedding_model"))
    third = F.col("vec_id") % 3
    stored = rows.withColumn("embedding", F.coalesce(vector(third == 0, 2.0), vector((third == 1) & (F.col("project_id") % 2 == 0), 4.0)))
    cache = rows.filter((third == 1) & (F.col("project_id") % 2 == 0)).withColumn("embedding", F.array(F.lit(3.0)).cast("array<float>"))
    root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    columns = ["project_id", "content", "content_hash", "embedding", "embedding_model"]
    versions.publish(spark, root, {"chunks": stored.select(*columns), "cache": cache.select("project_id", "content_hash", "embedding", "embedding_model")})
    drafts = rows.filter("project_id % 2 = 0").select("project_id", "content")
    fresh = vectors.embed_missing(drafts, versions.read_version(spark, root, "chunks"), versions.read_version(spark, root, "cache"), "m", one_number, 1)
    vectors.publish_knowledge(spark, root, drafts, "m", fresh)
    first = F.col("embedding")[0]
    out = versions.read_version(spark, root, "chunks")
    return out.groupBy("project_id").agg(F.count("*").alias("chunks"), F.count_if(first == 2.0).alias("stored"), F.count_if(first == 3.0).alias("cached"), F.count_if(first == 1.0).alias("fresh"))


def one_number(texts: list[str]) -> list[list[float]]:
    return [[1.0] for _ in texts]


#: Events come in twenty batches by the hour of their id; a row is late when an earlier batch has one newer by over ten days.
LATE_SQL = """b AS (SELECT *, (event_id * 7919) % 20 AS batch FROM events), x AS (SELECT batch, max(ts) AS newest FROM b GROUP BY batch), s AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x),
l AS (SELECT b.*, coalesce(ts < seen - INTERVAL 10 DAY, false) AS late FROM b JOIN s USING (batch)), r AS (SELECT *, row_number() OVER (PARTITION BY event_id // 2 ORDER BY batch, ts, user_id) AS n FROM l WHERE NOT late)"""


def arriving_of(spark, sf_dir) -> DataFrame:
    """Events as calls, two of which share an id."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 2).alias("event_id"), "user_id", (F.col("event_id") % 50).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") * 7919 % 20).alias("batch"))


@query(f"WITH {LATE_SQL} SELECT batch, count(*) FILTER (WHERE late) AS late, (SELECT count(*) FROM r WHERE r.batch = l.batch AND n > 1) AS repeated FROM l GROUP BY batch")
def t2_late_rows(spark, sf_dir):
    return jobs.late_counters(arriving_of(spark, sf_dir), 10 * 86_400)[1]


@query(f"WITH {LATE_SQL} SELECT user_id, date_trunc('day', ts) AS day, sum(event_id % 50 + 1)::BIGINT AS tokens, count(*) AS calls FROM r WHERE n = 1 GROUP BY ALL")
def t2_timely_counters(spark, sf_dir):
    return jobs.late_counters(arriving_of(spark, sf_dir), 10 * 86_400)[0].withColumn("day", F.col("day").cast("timestamp_ntz"))


def sentences_of(path: str, content: str) -> list:
    """Stands for a parser: a declaration for each line that is not blank."""
    found, at = [], 0
    for number, line in enumerate(content.split("\n"), 1):
        if line.strip(" \t\r"):
            found.append(("function_declaration", path.rsplit("/", 1)[-1], at, at + len(line), number, number))
        at += len(line) + 1
    return found


@query(f"""WITH {FILES}, l AS (SELECT project_id, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS t FROM files)
SELECT project_id, path AS file_path, count(*) AS spans, sum(length(t))::BIGINT AS chars, max(line)::INT AS last FROM l WHERE trim(t, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL""")
def x5_extracted_spans(spark, sf_dir):
    spans = chunks.extracted_spans(files_of(spark, sf_dir), sentences_of)
    return spans.groupBy("project_id", "file_path").agg(F.count("*").alias("spans"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("chars"), F.max("end_line").alias("last"))
