"""Queries on archive entries, paths, findings and log lines whose SQL holds what is expected, typed anew and not taken from the library."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunks, findings, lifecycle, review
from ..operators.graph import shared_folder
from ..sources import archives, tables
from ..sources.tables import read_table
from ..streaming import jobs
from .corpus_queries import ALL_RULES_SQL, all_findings_of, tables_of
from .operator_queries import SAMPLE_SQL, redact_sql
from .registry import query
from .table_queries import account_tables

# Archive entries: pages as files of five projects.

#: What a page's path ends with, by its id, and whether such an entry may be read.
ENDINGS = [
    ("/src/a.ts", True), ("/package-lock.json", False), ("/.env", False), ("/.env.local", False), ("/id_rsa", False), ("/server.pem", False), ("/logo.png", False), ("/lib.min.js", False), ("/vendor/x.js", True), ("/node_modules/x.js", False),
    ("/public/vendor/x.js", False), ("/readme.md", True), ("/Dist/x.js", False), ("/.npmrc", False), ("/app/env.ts", True), ("/", False), ("/pnpm-lock.yaml", False), ("/.github/ci.yml", True), ("/../x.ts", False), ("/font.WOFF2", False),
]


def ended(page: Column, ends: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in ends]), (page % len(ends) + 1).cast("int"))


@query(f"SELECT page_id, {[kept for _, kept in ENDINGS]}[page_id % {len(ENDINGS)} + 1] AS kept FROM pages")
def s3_excluded_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), ended(F.col("page_id"), [e for e, _ in ENDINGS]))
    return p.select("page_id", paths.keep_path(path).alias("kept"))


def entries_of(spark, sf_dir) -> DataFrame:
    """project_id, entry_path, size_bytes, bytes, verdict: four projects whose entries share a folder, and one whose do not."""
    n = F.col("page_id")
    folder = F.when(n % 5 == 4, F.concat(F.lit("top"), (n % 2).cast("string"))).otherwise(F.concat(F.lit("repo-"), (n % 5).cast("string")))
    path = F.concat(folder, F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("src", "lib", "tests")]), (n % 3 + 1).cast("int")), F.lit("/f"), n.cast("string"), ended(n, [".ts", ".js", ".md", ".generated.ts"]))
    html = F.coalesce("html", F.lit(""))
    verdict = F.when(n % 11 == 7, "too_large").otherwise("ok")
    body = F.when(n % 13 == 3, F.concat(html, F.lit("\x00"))).otherwise(html)
    return read_table(spark, sf_dir, "pages").select((n % 5).cast("string").alias("project_id"), path.alias("entry_path"), F.octet_length(body).cast("long").alias("size_bytes"), F.encode(body, "UTF-8").alias("bytes"), verdict.alias("verdict"), "page_id")


ENTRIES_SQL = """e AS (SELECT page_id, (page_id % 5)::VARCHAR AS project_id, CASE WHEN page_id % 5 = 4 THEN 'top' || page_id % 2 ELSE 'repo-' || page_id % 5 END AS folder,
['src', 'lib', 'tests'][page_id % 3 + 1] || '/f' || page_id || ['.ts', '.js', '.md', '.generated.ts'][page_id % 4 + 1] AS rest, coalesce(html, '') AS body, page_id % 11 <> 7 AS fits, page_id % 13 = 3 AS nul FROM pages)"""


@query(f"WITH {ENTRIES_SQL} SELECT page_id, CASE WHEN page_id % 5 = 4 THEN folder || '/' || rest ELSE rest END AS entry_path FROM e")
def s2_common_root(spark, sf_dir):
    return archives.strip_common_root(entries_of(spark, sf_dir)).select("page_id", "entry_path")


IGNORE = "# made by a tool\n*.generated.ts\n/lib/\n!lib/f1*.js\ntests/f?.md\n"


@query(f"""WITH {ENTRIES_SQL} SELECT page_id FROM e WHERE NOT coalesce(list_last(list_filter([
  CASE WHEN regexp_matches(rest, '[.]generated[.]ts$') THEN 'out' END, CASE WHEN starts_with(rest, 'lib/') THEN 'out' END, CASE WHEN regexp_matches(rest, '^lib/f1[^/]*[.]js$') THEN 'in' END, CASE WHEN regexp_matches(rest, '^tests/f[^/][.]md$') THEN 'out' END], lambda x: x IS NOT NULL)), 'in') = 'out'""")
def s4_ignored_files(spark, sf_dir):
    """Every project has the same ignore file, which its files are held against."""
    own = entries_of(spark, sf_dir).select("page_id", "project_id", F.regexp_replace("entry_path", "^[^/]*/", "").alias("path"))
    made = own.select("project_id").distinct().select("project_id", F.lit(".gitignore").alias("path"), F.lit(IGNORE).alias("content"))
    return archives.apply_ignore(own, archives.ignore_patterns(made)).select("page_id")


@query(f"WITH {ENTRIES_SQL} SELECT project_id, folder || '/' || rest AS path, sha256(body) AS content, strlen(body) AS size_bytes FROM e WHERE fits AND NOT nul")
def s5_decoded_texts(spark, sf_dir):
    return archives.decode_text(entries_of(spark, sf_dir)).select("project_id", "path", F.sha2("content", 256).alias("content"), "size_bytes")


@query(f"""WITH {ENTRIES_SQL}, s AS (SELECT *, regexp_matches(rest, '[.](ts|js)$') AS source FROM e), v AS (SELECT project_id, count(*) FILTER (WHERE source) AS n, sum(CASE WHEN source AND fits THEN strlen(body) + nul::INT ELSE 0 END)::BIGINT AS total_bytes, count(*) FILTER (WHERE source AND NOT fits) AS skipped_large FROM s GROUP BY project_id)
SELECT project_id, n <= {archives.MAX_FILES} AND total_bytes <= {archives.MAX_BYTES} AS ok, CASE WHEN n > {archives.MAX_FILES} THEN 'too many source files' WHEN total_bytes > {archives.MAX_BYTES} THEN 'too large' END AS error, total_bytes, skipped_large FROM v""")
def s6_import_verdicts(spark, sf_dir):
    return archives.import_verdict(entries_of(spark, sf_dir))


@query("""SELECT (page_id % 200)::VARCHAR AS project_id, CASE WHEN bool_or(page_id % 3 = 1 AND page_id // 200 % 4 = 1) THEN 'Express' WHEN bool_or(page_id // 200 % 4 = 2) THEN 'Nuxt' WHEN bool_or(page_id % 4 = 0) THEN 'TypeScript' ELSE 'JavaScript' END AS framework FROM pages GROUP BY ALL""")
def c8_frameworks(spark, sf_dir):
    """By a manifest, whose shallowest copy counts, else by a configuration file, else by language."""
    n = F.col("page_id")
    of = read_table(spark, sf_dir, "pages").select("page_id", (n % 200).cast("string").alias("project_id"))
    manifest = F.when((n % 3 == 1) & (F.floor(n / 200) % 4 == 1), "package.json")
    config = F.when(F.floor(n / 200) % 4 == 2, "nuxt.config.ts")
    plain = F.concat(F.lit("src/f"), n.cast("string"), F.when(n % 4 == 0, ".ts").otherwise(".js"))
    files = of.select("project_id", F.explode(F.array_compact(F.array(manifest, config, plain, F.when(n % 2 == 0, "deep/package.json")))).alias("path"))
    content = F.when(F.col("path") == "package.json", '{"devDependencies":{"express":"4"},"dependencies":{"left-pad":"1"}}').when(F.col("path") == "deep/package.json", '{"dependencies":{"lodash":"3"}}')
    return archives.detect_framework(files.withColumn("content", content), files)


@query("SELECT (page_id % 5)::VARCHAR AS project_id, count(*) AS files, count(*) FILTER (WHERE page_id % 5 < 2) AS replaced FROM pages WHERE page_id % 5 >= 2 OR page_id % 2 = 0 GROUP BY ALL")
def s8_project_files(spark, sf_dir):
    """All projects are written, then two of them with half of their files, which replaces these two alone."""
    n = F.col("page_id")
    p = read_table(spark, sf_dir, "pages").select((n % 5).cast("string").alias("project_id"), n.cast("string").alias("path"), F.lit(1).alias("version"), "page_id")
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    tables.write_project_files(p, root)
    tables.write_project_files(p.filter((n % 5 < 2) & (n % 2 == 0)).withColumn("version", F.lit(2)), root)
    back = spark.read.schema("path string, version int, page_id long, project_id string").parquet(root)
    return back.groupBy("project_id").agg(F.count("*").alias("files"), F.count_if(F.col("version") == 2).alias("replaced"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def s15_written_result(spark, sf_dir):
    """A run's result, written to the folder of its date and commit and read again."""
    folder = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    measured = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    tables.write_result(measured, folder, "2026-01-01", "abc123")
    return spark.read.schema(measured.schema).json(f"{folder}/2026-01-01-abc123")


# Hashes, days, names.


@query("""SELECT doc_id, sha256('owner/' || doc_id) AS key, sha256('{"model":"m","prompt":"v1","project":"p' || doc_id || '",' || CASE WHEN doc_id % 2 = 0 THEN '"framework":"Next.js",' ELSE '' END || '"sample":[{"path":"a.ts","line":' || doc_id || '},{"path":"b.ts","line":2}]}') AS input FROM documents""")
def f3_input_hashes(spark, sf_dir):
    n = F.col("doc_id")
    item = lambda path, line: F.struct(F.lit(path).alias("path"), line.cast("long").alias("line"))
    key = text.key_hash(F.concat(F.lit("owner/"), n.cast("string")))
    made = text.review_input_hash(F.lit("m"), F.lit("v1"), F.concat(F.lit("p"), n.cast("string")), F.when(n % 2 == 0, "Next.js"), F.array(item("a.ts", n), item("b.ts", F.lit(2))))
    return read_table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), made.alias("input"))


@query("SELECT event_id, date_trunc('day', ts) AS day FROM events")
def f16_quota_days(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", text.quota_day(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"))


@query("SELECT event_id, [NULL, NULL, 'a/b.ts', NULL, 'null.ts', 'x'][event_id % 6 + 1] AS path FROM events")
def f8_plain_paths(spark, sf_dir):
    made = ended(F.col("event_id"), [" \t", "Null", " a/b.ts ", "", "null.ts", "\nx\n"])
    return read_table(spark, sf_dir, "events").select("event_id", text.norm_path(made).alias("path"))


@query("SELECT event_id, ['src/a.ts', 'src/a.ts,lib/b-c.jsx', '', 'x.mjs,y.cts', 'own/node.js'][event_id % 5 + 1] AS cited FROM events")
def f12_citations(spark, sf_dir):
    said = ["See ./src/a.ts:L1-L9 and src/a.ts.", "In `src/a.ts`, lib/b‐c.jsx", "Use Node.js and Vue.js, or socket.io.js", "x.mjs y.cts x.mjs", "own/node.js is ours"]
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(text.citations(ended(F.col("event_id"), said)), ",").alias("cited"))


# Findings.

#: The fifty worst findings of the project that comes first, as a report lists them.
LISTED = "SELECT project_id, severity, category, ord, rule FROM found"
RANKED = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query(f"WITH {ALL_RULES_SQL} {LISTED} ORDER BY project_id, {RANKED}, lower(category), ord LIMIT 50")
def o1_sorted_findings(spark, sf_dir):
    """The first fifty, as a page of a list shows them."""
    return findings.sort_findings(all_findings_of(tables_of(spark, sf_dir))).limit(50).select("project_id", "severity", "category", "ord", "rule")


@query(f"WITH {ALL_RULES_SQL} {LISTED} WHERE severity = 'high' AND category = 'testing'")
def p18_filtered_issues(spark, sf_dir):
    return findings.filter_issues(all_findings_of(tables_of(spark, sf_dir)), "high", "testing").select("project_id", "severity", "category", "ord", "rule")


@query(f"WITH {ALL_RULES_SQL} SELECT project_id, rule, category, severity, file_path, row_number() OVER (PARTITION BY project_id, rule ORDER BY {RANKED}, ord) - 1 AS at FROM found")
def a40_occurrences(spark, sf_dir):
    found = findings.expand_occurrences(findings.group_findings(all_findings_of(tables_of(spark, sf_dir))))
    return found.select("project_id", "rule", "category", "severity", "file_path", F.col("at").cast("long").alias("at"))


@query(f"WITH {ALL_RULES_SQL} SELECT project_id, ord, rule FROM found UNION ALL SELECT source, 1000000 + doc_id, NULL FROM documents WHERE doc_id % 9 = 0")
def u1_all_findings(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").filter("doc_id % 9 = 0")
    reviews = d.select(F.col("source").alias("project_id"), F.col("doc_id").cast("int").alias("ord"), *[F.lit(x).alias(c) for c, x in (("category", "security"), ("severity", "low"), ("title", "t"), ("description", "d"), ("file_path", "f"))])
    return findings.all_findings(all_findings_of(tables_of(spark, sf_dir)), reviews).select("project_id", "ord", "rule")


@query("SELECT 'src/' || lower(l_returnflag) || '.ts' AS file_path, l_orderkey AS start_line FROM lineitem ORDER BY file_path, start_line LIMIT 100")
def o2_ordered_places(spark, sf_dir):
    """The first hundred places, by path and line."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src/"), F.lower("l_returnflag"), F.lit(".ts")).alias("file_path"), F.col("l_orderkey").alias("start_line"))
    return review.order_by_path(rows).limit(100)


# A review's sample among server code, other code, screens and tests.

MIXED_FILES = "SELECT source AS project_id, ['server', 'lib', 'ui', 'tests'][doc_id % 4 + 1] || '/doc_' || doc_id || ['.ts', '.ts', '.tsx', '.test.ts'][doc_id % 4 + 1] AS path, coalesce(text, '') AS content FROM documents"
PRIORITY = "CASE split_part(file_path, '/', 1) WHEN 'server' THEN 0 WHEN 'ui' THEN 2 ELSE 1 END"
MIXED_SQL = SAMPLE_SQL.replace("SELECT source AS project_id, lang || '/doc_' || doc_id || '.ts' AS path, coalesce(text, '') AS content FROM documents", f"SELECT * FROM ({MIXED_FILES}) QUALIFY path NOT LIKE 'tests/%' OR count(*) FILTER (WHERE path NOT LIKE 'tests/%' AND content <> '') OVER (PARTITION BY project_id) = 0").replace("CASE WHEN risk > 0 THEN 1 ELSE 5 END", f"CASE WHEN risk > 0 THEN 0 ELSE 4 END + {PRIORITY}")


@query(f"{MIXED_SQL} SELECT project_id, file_path, seq, chars FROM s")
def w9_mixed_sample(spark, sf_dir):
    """Tests are shown of the projects that have nothing else; server code comes before other code, and that before screens."""
    n = F.col("doc_id")
    path = F.concat(ended(n, ["server", "lib", "ui", "tests"]), F.lit("/doc_"), n.cast("string"), ended(n, [".ts", ".ts", ".tsx", ".test.ts"]))
    files = read_table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return review.review_sample(chunks.split_text(files)).select("project_id", "file_path", "seq", "chars")


# Redaction by content, and rows of accounts before they are erased.


@query(f"WITH r AS (SELECT doc_id, {redact_sql(text.LOG_SECRETS)} AS t FROM documents) SELECT doc_id::VARCHAR AS id, '[REDACTED]' AS token, sha256(CASE WHEN length(t) > 2000 THEN t[1:2000] || '…' ELSE t END) AS message FROM r")
def t7_redacted_lines(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.col("text").alias("message"), F.lit("x").alias("accessToken")).alias("inner"))).alias("value"))
    out = jobs.redact_stream(lines)
    of = lambda path: F.get_json_object("value", path)
    return out.select(of("$.id").alias("id"), of("$.inner.accessToken").alias("token"), F.sha2(of("$.inner.message"), 256).alias("message"))


@query("""SELECT 'users' AS table_name, count(*) AS rows FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'projects', count(*) FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT 'files', 0 UNION ALL SELECT 'tokens', count(*) FROM customer WHERE c_custkey % 7 = 0""")
def u5_rows_to_erase(spark, sf_dir):
    return lifecycle.leftovers(*account_tables(spark, sf_dir))


@query("""SELECT 'users' AS table_name, c_custkey AS key, 1 AS n FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'projects', o_orderkey, count(*) FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_orderkey
UNION ALL SELECT 'files', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0) GROUP BY l_orderkey UNION ALL SELECT 'tokens', c_custkey, 1 FROM customer WHERE c_custkey % 7 <> 0""")
def m7_rows_that_stay(spark, sf_dir):
    """Which rows an erasure leaves, and not only how many."""
    out = lifecycle.erase_accounts(*account_tables(spark, sf_dir))
    number = F.regexp_extract("email", r"(\d+)$", 1).cast("long")
    keys = {"users": F.col("user_id"), "projects": F.col("project_id"), "files": F.col("project_id"), "tokens": number}
    parts = [df.groupBy(keys[name].cast("long").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "key", "n") for name, df in out.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_id, CASE WHEN event_id % 100 NOT IN (3, 40) THEN event_id % 100 END AS project_id FROM events")
def m8_calls_that_stay(spark, sf_dir):
    """Calls of two deleted projects keep everything but the project."""
    calls = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("project_id"))
    return lifecycle.delete_projects({"calls": calls}, calls.filter("project_id IN (3, 40)").select("project_id"))["calls"]
