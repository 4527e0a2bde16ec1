"""Queries on documents, pages and embeddings, seen as projects, files, imports and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunks, evals, findings, graph, review, rules, scoring, vectors
from ..sources import archives, tables
from .registry import ORACLE_SQL, query
from .report import project_tables

LARGE = 60
FILES = "files AS (SELECT source AS project_id, lang || '/doc_' || doc_id || '.ts' AS path, coalesce(text, '') AS content FROM documents)"
PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]+/(.*)$', 1), '[?#].*$', '') || CASE page_id % 9 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.test.tsx' WHEN 2 THEN '/__tests__/api/userRoutes.spec.js' WHEN 3 THEN '/fixtures/a.min.js' WHEN 4 THEN '/authToken.ts' WHEN 5 THEN '/node_modules/x.js' WHEN 6 THEN '/next.config.mjs' WHEN 7 THEN '/public/vendor/lib.jsx' ELSE '/server/db.ts' END AS path FROM pages)"
SECRETS = r"""hits AS (SELECT project_id, path, line, CASE WHEN regexp_matches(t, '(?i)\b(api[_-]?key|secret|token|password|private[_-]?key)\b\s*[:=]\s*[''"][^''"\s]{8,}[''"]') THEN 'Hardcoded API key / token assignment'
  WHEN regexp_matches(t, '(?i)\bjwt[_-]?secret\b\s*[:=]\s*[''"][^''"]+[''"]') THEN 'JWT-like secret literal' WHEN regexp_matches(t, 'AKIA[0-9A-Z]{16}') THEN 'AWS-style access key pattern' END AS hint
  FROM (SELECT project_id, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS t FROM files))"""
PENALTY = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 ELSE 2 END"
LARGE_SQL = f"large AS (SELECT project_id, path, len(string_split(content, chr(10))) AS lines FROM files WHERE len(string_split(content, chr(10))) >= {LARGE})"
RULES_SQL = f"""{FILES}, {SECRETS}, {LARGE_SQL},
found AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY lines DESC, path) AS ord, 'large-file' AS rule, 'codeQuality' AS category, CASE WHEN lines >= 80 THEN 'high' ELSE 'medium' END AS severity, path AS file_path FROM large
  QUALIFY ord <= 10 UNION ALL SELECT project_id, 4000 + row_number() OVER (PARTITION BY project_id ORDER BY path, line) AS ord, 'hardcoded-secret', 'security', 'critical', path FROM hits WHERE hint IS NOT NULL QUALIFY ord <= 4010)"""

#: All five rules: no document's path is a test's, so that nothing is tested, or has a critical word, whatever its logic.
ALL_RULES_SQL = f"""{RULES_SQL.replace("found AS (", "two AS (")}, functions AS (SELECT project_id, path, len(string_split(content, chr(10))) AS lines FROM files), critical AS (SELECT project_id, path FROM files WHERE list_has_any(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[/._\\-\\s]+'), {paths.CRITICAL_WORDS + [w + "s" for w in paths.CRITICAL_WORDS]})),
found AS (SELECT * FROM two UNION ALL SELECT project_id, 1000 + row_number() OVER (PARTITION BY project_id ORDER BY lines DESC, path) AS ord, 'complex-function', 'codeQuality', CASE WHEN lines >= 150 THEN 'high' ELSE 'medium' END, path FROM functions WHERE lines >= 80 QUALIFY ord <= 1012
  UNION ALL SELECT DISTINCT project_id, 2001, 'low-test-coverage', 'testing', 'high', NULL FROM files UNION ALL SELECT project_id, 3000 + row_number() OVER (PARTITION BY project_id ORDER BY path) AS ord, 'untested-critical-path', 'testing', 'high', path FROM critical QUALIFY ord <= 3008)"""


def files_of(spark, sf_dir) -> DataFrame:
    d = tables.read_table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project_id"), F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def paths_of(spark, sf_dir) -> DataFrame:
    p = tables.read_table(spark, sf_dir, "pages").select("page_id", "url")
    ends = ["/index.ts", ".test.tsx", "/__tests__/api/userRoutes.spec.js", "/fixtures/a.min.js", "/authToken.ts", "/node_modules/x.js", "/next.config.mjs", "/public/vendor/lib.jsx", "/server/db.ts"]
    bare = F.regexp_replace(F.regexp_extract("url", "://[^/]+/(.*)$", 1), "[?#].*$", "")
    return p.select("page_id", F.concat(bare, F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("page_id") % 9 + 1).cast("int"))).alias("path"))


def findings_of(spark, sf_dir) -> DataFrame:
    files = files_of(spark, sf_dir)
    return rules.run_rules({"large_files": rules.large_files(files, LARGE), "secret_hits": rules.secret_hits(files)}, rules.RULES | {"large-file": ("large_files", lambda df: rules.rule_large_file(df, 80))})


def tables_of(spark, sf_dir) -> dict[str, DataFrame]:
    """What all rules read, of documents as files with one function each, as long as the file."""
    files = files_of(spark, sf_dir)
    sizes = files.select("project_id", F.col("path").alias("file_path"), F.col("path").alias("name"), text.line_count(F.col("content")).alias("lines"))
    return project_tables(files, sizes, LARGE)


def all_findings_of(read: dict[str, DataFrame]) -> DataFrame:
    return rules.run_rules(read, rules.RULES | {"large-file": ("large_files", lambda df: rules.rule_large_file(df, 80))}, whole=True)


@query(f"WITH {PATHS} SELECT page_id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '[^/]*$', '') AS dir, regexp_replace(regexp_replace(path, '(?i)\\.(jsx?|tsx?)$', ''), '/index$', '') AS module, regexp_matches(path, '(?i)(^|/)(index|server)\\.[jt]sx?$') AS facade, array_to_string(list_filter(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[/._\\-\\s]+'), lambda x: x <> ''), ' ') AS words FROM paths")
def p2_path_cols(spark, sf_dir):
    p = F.col("path")
    return paths_of(spark, sf_dir).select("page_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.module_key(p).alias("module"), paths.is_facade(p).alias("facade"), F.array_join(paths.path_words(p), " ").alias("words"))


@query(f"WITH {PATHS} SELECT page_id, regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.test\\.|\\.spec\\.') OR contains(path, '__tests__/') OR regexp_matches(path, '(^|/)tests?/') AS is_test, regexp_matches(path, '(^|/)(__fixtures__|fixtures|__mocks__)/') AS is_fixture, regexp_matches(path, '(?i)\\.(jsx?|tsx?)$') AS is_source FROM paths")
def p3_test_files(spark, sf_dir):
    p = F.col("path")
    return paths_of(spark, sf_dir).select("page_id", paths.is_test_file(p).alias("is_test"), paths.is_test_support(p).alias("is_fixture"), paths.is_source_file(p).alias("is_source"))


@query(f"WITH {PATHS} SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '(?i)\\.(jsx?|tsx?)$', ''), '(?i)\\.test$', ''), '(?i)\\.spec$', ''), '/__tests__/', '/'), '/tests?/', '/') AS guess FROM paths")
def p5_guess_source(spark, sf_dir):
    return paths_of(spark, sf_dir).select("page_id", paths.guess_source(F.col("path")).alias("guess"))


@query(f"WITH {PATHS} SELECT page_id, CASE WHEN regexp_matches(path, '(?i)\\.config\\.[cm]?[jt]s$|\\.d\\.ts$') THEN 3 WHEN regexp_matches(path, '(?i)\\.[jt]sx$|\\.component\\.[jt]s$|^(frontend|client)/|(^|/)(static|public|assets)/') THEN 2 WHEN list_has_any(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[/._\\-\\s]+'), {paths.SERVER_WORDS}) THEN 0 ELSE 1 END AS priority FROM paths")
def p8_path_priority(spark, sf_dir):
    return paths_of(spark, sf_dir).select("page_id", paths.path_priority(F.col("path")).alias("priority"))


@query(f"WITH {PATHS} SELECT page_id, NOT (list_has_any(string_split(lower(path), '/'), {paths.EXCLUDED_DIRS}) OR regexp_matches(lower(path), '(^|/)(assets|public|static)/(.*/)?vendor(/|$)|^vendor(/|$)|\\.min\\.[cm]?js$') OR path = '' OR path LIKE '%/' OR path LIKE '/%') AS kept FROM paths")
def s3_keep_path(spark, sf_dir):
    return paths_of(spark, sf_dir).select("page_id", paths.keep_path(F.col("path")).alias("kept"))


@query(f"WITH {FILES} SELECT project_id, path, {' + '.join('regexp_matches(content, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')::INT' for p in text.RISK_SIGNALS)} AS risk FROM files")
def p9_risk_score(spark, sf_dir):
    return files_of(spark, sf_dir).select("project_id", "path", text.risk_score(F.col("content")).alias("risk"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', '', 'g'), '(^|[^:\"''`])//[^\\n]*', '\\1', 'g'), '\"(?:[^\"\\\\\\n]|\\\\.)*\"|''(?:[^''\\\\\\n]|\\\\.)*''|`(?:[^`\\\\]|\\\\.)*`', '\"\"', 'g')) AS code FROM pages")
def p6_code_only(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "pages").select("page_id", F.sha2(text.code_only(F.col("html")), 256).alias("code"))


@query(f"WITH {FILES} SELECT project_id, path, sha256(content) AS content_hash, greatest(1, ceil(length(content) / 4))::INT AS tokens, least(length(content), 2500) + CASE WHEN length(content) > 2500 THEN 22 ELSE 0 END + length(path) + 150 AS chars, length(CASE WHEN length(content) > 1000 THEN content[1:1000] || '…' ELSE content END) AS cut FROM files".replace("> 2500 THEN 22", f"> 2500 THEN {len(text.CUT_MARK) + 1}"))
def f1_text_measures(spark, sf_dir):
    c = F.col("content")
    return files_of(spark, sf_dir).select("project_id", "path", text.content_hash(c).alias("content_hash"), text.est_tokens(c).alias("tokens"), text.snippet_chars(c, F.col("path")).alias("chars"), F.length(text.cut(c, 1000, "…")).alias("cut"))


@query()
def f4_prompt_version(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fnv1a32(F.col("text")).alias("version"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM conversations")
def f7_collapse_ws(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.collapse_ws(F.col("text")).alias("plain"))


@query()
def f10_redact_public(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.redact_public(F.col("text")), 256).alias("redacted"), (text.redact_public(F.col("text")) != F.col("text")).alias("changed"))


@query(f"WITH {FILES}, {LARGE_SQL} SELECT * FROM large")
def a1_large_files(spark, sf_dir):
    return rules.large_files(files_of(spark, sf_dir), LARGE)


@query(f"WITH {FILES}, {SECRETS} SELECT project_id, path, line, hint FROM hits WHERE hint IS NOT NULL")
def a3_secret_hits(spark, sf_dir):
    return rules.secret_hits(files_of(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT project_id, ord, rule, category, severity, file_path FROM found")
def u2_run_rules(spark, sf_dir):
    return findings_of(spark, sf_dir).select("project_id", "ord", "rule", "category", "severity", "file_path")


@query(f"WITH {RULES_SQL} SELECT project_id, rule, count(*) AS n, arg_min(severity, {{'r': CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, 'o': ord}}) AS severity, CASE WHEN count(*) = 1 THEN NULL WHEN rule = 'large-file' THEN 'Large files (' || count(*) || ')' ELSE 'Potential hardcoded secrets (' || count(*) || ')' END AS title FROM found GROUP BY project_id, rule")
def a12_group_findings(spark, sf_dir):
    g = findings.group_findings(findings_of(spark, sf_dir))
    return g.select("project_id", "rule", F.size("occurrences").cast("long").alias("n"), "severity", F.when(F.size("occurrences") > 1, F.col("title")).alias("title"))


@query(f"WITH {RULES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, ord) AS rn FROM found) SELECT project_id, rule, sum({PENALTY} * pow(0.5, rn - 1)) AS penalty FROM r GROUP BY project_id, rule")
def a13_finding_penalty(spark, sf_dir):
    return scoring.finding_penalty(findings.group_findings(findings_of(spark, sf_dir))).select("project_id", "rule", "penalty")


HEALTH_SQL = f"""WITH {RULES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, ord) AS rn FROM found),
p AS (SELECT project_id, sum({PENALTY} * pow(0.5, rn - 1)) AS pen FROM r WHERE category = 'security' GROUP BY project_id),
h AS (SELECT project_id, count(*) AS n FROM hits WHERE hint IS NOT NULL GROUP BY project_id),
s AS (SELECT project_id, greatest(0, least(100, floor(CASE WHEN coalesce(n, 0) > 0 THEN 70 ELSE 90 END - coalesce(pen, 0) + 0.5)))::INT AS security FROM (SELECT DISTINCT project_id FROM files) LEFT JOIN h USING (project_id) LEFT JOIN p USING (project_id))
SELECT project_id, 88 AS architecture, security, 86 AS performance, 100 AS codeQuality, 0 AS testing, floor((88 + security + 86 + 100 + 0) / 5 + 0.5)::INT AS health FROM s"""


@query(HEALTH_SQL)
def a16_health(spark, sf_dir):
    """Secret hits, rules, groups, penalties, category scores and health of every project."""
    files = files_of(spark, sf_dir)
    sizes = spark.createDataFrame([], "project_id string, file_path string, name string, lines int")
    tested = spark.createDataFrame([], "project_id string, tested_percent int")
    return scoring.diminishing_scores(rules.project_measures(files, sizes, tested, LARGE), findings.group_findings(findings_of(spark, sf_dir)))


@query(f"WITH {RULES_SQL}, p AS (SELECT project_id, sum(CASE WHEN category = 'security' THEN 20 ELSE 0 END) AS sec, sum(CASE WHEN category = 'codeQuality' THEN {PENALTY} ELSE 0 END) AS cq FROM found GROUP BY project_id), l AS (SELECT project_id, count(*) AS n FROM large GROUP BY project_id), h AS (SELECT project_id, count(*) AS n FROM hits WHERE hint IS NOT NULL GROUP BY project_id), s AS (SELECT project_id, greatest(0, CASE WHEN coalesce(h.n, 0) > 0 THEN 70 ELSE 90 END - coalesce(sec, 0))::INT AS security, greatest(0, CASE WHEN coalesce(l.n, 0) > 8 THEN 72 ELSE 85 END - coalesce(cq, 0))::INT AS codeQuality FROM (SELECT DISTINCT project_id FROM files) LEFT JOIN p USING (project_id) LEFT JOIN l USING (project_id) LEFT JOIN h USING (project_id)) SELECT project_id, 88 AS architecture, security, 86 AS performance, codeQuality, 40 AS testing, floor((88 + security + 86 + codeQuality + 40) / 5 + 0.5)::INT AS health FROM s")
def a17_linear_scores(spark, sf_dir):
    files = files_of(spark, sf_dir)
    sizes = spark.createDataFrame([], "project_id string, file_path string, name string, lines int")
    tested = spark.createDataFrame([], "project_id string, tested_percent int")
    return scoring.linear_scores(rules.project_measures(files, sizes, tested, LARGE), findings_of(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT project_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM found GROUP BY project_id")
def a18_count_by_severity(spark, sf_dir):
    return findings.count_by_severity(findings_of(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT project_id, CASE rule WHEN 'large-file' THEN 'Large file' ELSE 'Potential hardcoded secret' END AS title, count(*) AS n FROM found GROUP BY project_id, rule")
def a19_findings_by_rule(spark, sf_dir):
    return findings.findings_by_rule(findings_of(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, category, ord) AS step, ord FROM found QUALIFY step <= 10")
def w14_roadmap(spark, sf_dir):
    return findings.roadmap(findings_of(spark, sf_dir)).select("project_id", "step", "ord")


@query(ORACLE_SQL["u2_run_rules"].replace(RULES_SQL, ALL_RULES_SQL))
def u2_run_rules_all(spark, sf_dir):
    return all_findings_of(tables_of(spark, sf_dir)).select("project_id", "ord", "rule", "category", "severity", "file_path")


@query(ORACLE_SQL["a12_group_findings"].replace(RULES_SQL, ALL_RULES_SQL).replace("ELSE 'Potential hardcoded secrets ('", "WHEN rule = 'complex-function' THEN 'Complex functions (' || count(*) || ')' WHEN rule = 'untested-critical-path' THEN 'Critical areas may lack tests (' || count(*) || ')' ELSE 'Potential hardcoded secrets ('"))
def a12_group_findings_all(spark, sf_dir):
    g = findings.group_findings(all_findings_of(tables_of(spark, sf_dir)))
    return g.select("project_id", "rule", F.size("occurrences").cast("long").alias("n"), "severity", F.when(F.size("occurrences") > 1, F.col("title")).alias("title"))


@query(ORACLE_SQL["a13_finding_penalty"].replace(RULES_SQL, ALL_RULES_SQL))
def a13_finding_penalty_all(spark, sf_dir):
    return scoring.finding_penalty(findings.group_findings(all_findings_of(tables_of(spark, sf_dir)))).select("project_id", "rule", "penalty")


ALL_BASES_SQL = """f AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE lines > 50) AS long, count(*) FILTER (WHERE lines >= 80) AS complex, count(*) FILTER (WHERE lines >= 60) AS large FROM functions GROUP BY project_id),
h AS (SELECT project_id, count(*) AS hits FROM hits WHERE hint IS NOT NULL GROUP BY project_id)"""
SCORES_SQL = "greatest(0, least(100, floor(CASE WHEN coalesce(hits, 0) > 0 THEN 70 ELSE 90 END - coalesce(sec, 0) + 0.5)))::INT AS security"
MEAN_SQL = "SELECT project_id, 88 AS architecture, security, 86 AS performance, codeQuality, testing, floor((88 + security + 86 + codeQuality + testing) / 5 + 0.5)::INT AS health FROM s"


@query(f"WITH {ALL_RULES_SQL}, {ALL_BASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, ord) AS rn FROM found), p AS (SELECT project_id, sum({PENALTY} * pow(0.5, rn - 1)) FILTER (WHERE category = 'security') AS sec FROM r GROUP BY project_id), s AS (SELECT project_id, {SCORES_SQL}, greatest(0, floor(100 - 4 * (100::DOUBLE * long / n) + 0.5))::INT AS codeQuality, 0 AS testing FROM f LEFT JOIN h USING (project_id) LEFT JOIN p USING (project_id)) {MEAN_SQL}")
def a16_health_all(spark, sf_dir):
    read = tables_of(spark, sf_dir)
    return scoring.diminishing_scores(read["measures"], findings.group_findings(all_findings_of(read)))


@query(f"WITH {ALL_RULES_SQL}, {ALL_BASES_SQL}, p AS (SELECT project_id, {', '.join(f'sum({PENALTY}) FILTER (WHERE category = {c}) AS {n}' for c, n in (('$security$', 'sec'), ('$codeQuality$', 'cq'), ('$testing$', 'tst')))} FROM found GROUP BY project_id), s AS (SELECT project_id, {SCORES_SQL}, greatest(0, CASE WHEN large + complex > 8 THEN 72 ELSE 85 END - coalesce(cq, 0))::INT AS codeQuality, greatest(0, 40 - coalesce(tst, 0))::INT AS testing FROM f LEFT JOIN h USING (project_id) LEFT JOIN p USING (project_id)) {MEAN_SQL}".replace("$", "'"))
def a17_linear_scores_all(spark, sf_dir):
    read = tables_of(spark, sf_dir)
    return scoring.linear_scores(read["measures"], all_findings_of(read))


@query(ORACLE_SQL["a18_count_by_severity"].replace(RULES_SQL, ALL_RULES_SQL))
def a18_count_by_severity_all(spark, sf_dir):
    return findings.count_by_severity(all_findings_of(tables_of(spark, sf_dir)))


@query(f"WITH {ALL_RULES_SQL} SELECT project_id, CASE rule WHEN 'large-file' THEN 'Large file' WHEN 'complex-function' THEN 'Complex function ' || regexp_replace(file_path, '[0-9]+', 'N', 'g') WHEN 'low-test-coverage' THEN 'Low test file coverage signal' WHEN 'untested-critical-path' THEN 'Critical area may lack tests' ELSE 'Potential hardcoded secret' END AS title, count(*) AS n FROM found GROUP BY ALL")
def a19_findings_by_rule_all(spark, sf_dir):
    return findings.findings_by_rule(all_findings_of(tables_of(spark, sf_dir)))


@query(ORACLE_SQL["w14_roadmap"].replace(RULES_SQL, ALL_RULES_SQL))
def w14_roadmap_all(spark, sf_dir):
    return findings.roadmap(all_findings_of(tables_of(spark, sf_dir))).select("project_id", "step", "ord")


@query(f"WITH {FILES}, p AS (SELECT project_id, path AS file_path, content, unnest(range(0, greatest(1, ceil((length(content) - 200) / 1400))::INT)) AS seq FROM files WHERE length(content) > 0), c AS (SELECT project_id, file_path, seq, content[seq * 1400 + 1:seq * 1400 + 1600] AS body, 1 + length(content[1:seq * 1400]) - length(replace(content[1:seq * 1400], chr(10), '')) AS start_line FROM p) SELECT project_id, file_path, seq, sha256(rtrim(body, ' ' || chr(9) || chr(10) || chr(13))) AS content, start_line::INT AS start_line, (start_line + len(string_split(body, chr(10))) - 1)::INT AS end_line FROM c WHERE rtrim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def c1_split_text(spark, sf_dir):
    return chunks.split_text(files_of(spark, sf_dir)).withColumn("content", F.sha2("content", 256))


def spans_of(spark, sf_dir) -> DataFrame:
    """Every line of a file as a declaration, every fifth as an expression."""
    lines = files_of(spark, sf_dir).select("project_id", F.col("path").alias("file_path"), "content", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    from pyspark.sql import Window

    ends = F.sum(F.length("line") + 1).over(Window.partitionBy("project_id", "file_path").orderBy("i"))
    return lines.select("project_id", "file_path", F.when(F.col("i") % 5 == 4, "expression_statement").otherwise("function_declaration").alias("node_type"), (ends - F.length("line") - 1).cast("int").alias("start_offset"), (ends - 1).cast("int").alias("end_offset"), (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"))


#: White space in Java's sense of `(?U)\\s`.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Lines as declarations, large ones in pieces, then neighbours joined by a recursion from chunk to chunk of each file.
CHUNKS_SQL = rf"""WITH RECURSIVE {FILES}, l AS (SELECT project_id, path AS file_path, unnest(range(0, len(string_split(content, chr(10))))) AS i, unnest(string_split(content, chr(10))) AS line FROM files WHERE regexp_matches(content, '[^\t-\r \x{{85}}\x{{A0}}]')),
t AS (SELECT project_id, file_path, i, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS body FROM l),
b AS (SELECT * FROM t WHERE body <> '' AND NOT (greatest(1, ceil(length(body) / 4)) < 20 AND i % 5 = 4)),
p AS (SELECT *, unnest(CASE WHEN ceil(length(body) / 4) > 400 THEN range(0, greatest(1, ceil((length(body) - 200) / 1400))::INT) ELSE [0] END) AS piece FROM b),
c AS (SELECT project_id, file_path, i, piece, CASE WHEN ceil(length(body) / 4) > 400 THEN regexp_replace(body[piece * 1400 + 1:piece * 1400 + 1600], '{BLANK}+$', '') ELSE body END AS content FROM p),
o AS (SELECT *, (row_number() OVER (PARTITION BY project_id, file_path ORDER BY i, piece)) AS place FROM c WHERE content <> ''),
m AS (SELECT project_id, file_path, place, 0 AS seq, content, i + 1 AS start_line, i + 1 AS end_line FROM o WHERE place = 1
  UNION ALL SELECT project_id, file_path, place, CASE WHEN fits THEN seq ELSE seq + 1 END, CASE WHEN fits THEN pair ELSE content END, CASE WHEN fits THEN start_line ELSE i + 1 END, i + 1
  FROM (SELECT o.project_id, o.file_path, o.place, o.i, o.content, m.seq, m.start_line, m.content || chr(10) || chr(10) || o.content AS pair, greatest(1, ceil(length(m.content) / 4)) < 200 AND ceil((length(m.content) + 2 + length(o.content)) / 4) <= 400 AS fits
    FROM m JOIN o ON o.project_id = m.project_id AND o.file_path = m.file_path AND o.place = m.place + 1))"""


@query(f"{CHUNKS_SQL} SELECT project_id, file_path, seq, sha256(arg_max(content, place)) AS content, arg_max(start_line, place)::INT AS start_line, arg_max(end_line, place)::INT AS end_line FROM m GROUP BY project_id, file_path, seq")
def c4_chunk_corpus(spark, sf_dir):
    out = chunks.chunk_corpus(files_of(spark, sf_dir), spans_of(spark, sf_dir))
    return out.select("project_id", "file_path", "seq", F.sha2("content", 256).alias("content"), "start_line", "end_line")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def w16_last_user_text(spark, sf_dir):
    return review.last_user_text(tables.read_table(spark, sf_dir, "conversations"))


def embedded(spark, sf_dir) -> DataFrame:
    return tables.read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("project_id"), F.col("vec_id").alias("chunk_id"), "embedding")


TOPK_SQL = """q AS (SELECT label AS project_id, vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT project_id, query_id, vec_id AS chunk_id, list_dot_product(e, embedding::DOUBLE[]) / sqrt(list_dot_product(e, e) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM q JOIN embeddings ON label = project_id),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8)"""


def topk_of(spark, sf_dir) -> DataFrame:
    e = embedded(spark, sf_dir)
    return vectors.vector_topk(e.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), e)


@query(f"WITH {TOPK_SQL} SELECT project_id, query_id, chunk_id, rank FROM k")
def w2_vector_topk(spark, sf_dir):
    """Queries are the embeddings whose id is divisible by 50, against all of their project."""
    return topk_of(spark, sf_dir).select("project_id", "query_id", "chunk_id", "rank")


EXPECTED_SQL = "r AS (SELECT q.project_id, q.query_id, min(CASE WHEN chunk_id % 3 = 1 THEN rank END) AS rank FROM q LEFT JOIN k USING (project_id, query_id) GROUP BY ALL)"


def ranks_of(spark, sf_dir) -> DataFrame:
    top = topk_of(spark, sf_dir).withColumn("file_path", (F.col("chunk_id") % 3).cast("string"))
    expected = embedded(spark, sf_dir).filter("chunk_id % 50 = 0").select("project_id", F.col("chunk_id").alias("query_id"), F.lit("1").alias("file_path"))
    return vectors.first_hit_rank(top, expected)


@query(f"WITH {TOPK_SQL}, {EXPECTED_SQL} SELECT * FROM r")
def w3_first_hit_rank(spark, sf_dir):
    return ranks_of(spark, sf_dir)


@query(f"WITH {TOPK_SQL}, {EXPECTED_SQL}, m AS (SELECT project_id, count(*) AS n, sum((coalesce(rank, 99) <= 8)::INT) AS h, sum((coalesce(rank, 99) = 1)::INT) AS f, sum(coalesce(1.0 / rank, 0)) AS rr FROM r GROUP BY project_id UNION ALL SELECT NULL, count(*), sum((coalesce(rank, 99) <= 8)::INT), sum((coalesce(rank, 99) = 1)::INT), sum(coalesce(1.0 / rank, 0)) FROM r) SELECT project_id, n AS questions, h / n AS recall_at_k, f / n AS hit_at_1, rr / n AS mrr FROM m")
def a28_retrieval_metrics(spark, sf_dir):
    return evals.retrieval_metrics(ranks_of(spark, sf_dir))


@query("WITH p AS (SELECT a.embedding::DOUBLE[] AS x, list_transform(a.embedding, lambda v: v * 1.001)::DOUBLE[] AS y FROM embeddings a) SELECT round(min(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))), 6) AS min_cosine, round(max(list_max(list_transform(list_zip(x, y), lambda v: abs(v[1] - v[2])))), 5) AS max_diff, count(*) AS n, true AS agrees FROM p")
def c16_vector_drift(spark, sf_dir):
    a = tables.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    b = a.withColumn("embedding", F.transform("embedding", lambda v: v * F.lit(1.001).cast("float")))
    out = vectors.vector_drift(a, b)
    return out.select(F.round("min_cosine", 6).alias("min_cosine"), F.round("max_diff", 5).alias("max_diff"), "n", "agrees")


STORE_SQL = f"{FILES}, d AS (SELECT project_id, sha256(content) AS content_hash, content FROM files), stored AS (SELECT DISTINCT project_id, content_hash FROM d WHERE length(content) % 3 = 0), missing AS (SELECT DISTINCT project_id, content_hash FROM d EXCEPT SELECT * FROM stored)"


def stored_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    drafts = files_of(spark, sf_dir).select("project_id", "content")
    vector = F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))
    stored = drafts.filter(F.length("content") % 3 == 0).select("project_id", text.content_hash(F.col("content")).alias("content_hash"), F.lit("m").alias("embedding_model"), vector.alias("embedding"))
    return drafts, stored, stored.limit(0)


@query(f"WITH {STORE_SQL} SELECT * FROM missing")
def j7_missing_chunks(spark, sf_dir):
    drafts, stored, cache = stored_of(spark, sf_dir)
    return vectors.missing_chunks(drafts, vectors.known_embeddings(stored, cache, "m")).select("project_id", "content_hash")


def fake_model(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]


@query(f"WITH {STORE_SQL} SELECT project_id, content_hash, least(8000, length(min(content)))::FLOAT AS first_value FROM d JOIN missing USING (project_id, content_hash) GROUP BY ALL")
def c10_embed_missing(spark, sf_dir):
    """With a model of two numbers, the text's length and 1."""
    drafts, stored, cache = stored_of(spark, sf_dir)
    return vectors.embed_missing(drafts, stored, cache, "m", fake_model, 2).select("project_id", "content_hash", F.col("embedding")[0].alias("first_value"))


@query(f"WITH {STORE_SQL} SELECT project_id, count(*) AS drafts, count(*) FILTER (WHERE content_hash IN (SELECT content_hash FROM stored s WHERE s.project_id = d.project_id)) AS reused FROM d GROUP BY project_id")
def j8_reuse_vectors(spark, sf_dir):
    drafts, stored, cache = stored_of(spark, sf_dir)
    known = vectors.known_embeddings(stored, cache, "m")
    fresh = vectors.embed_missing(drafts, stored, cache, "m", fake_model, 2)
    return vectors.reuse_vectors(drafts, known, fresh).filter("embedding IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("drafts"), F.count_if("reused").alias("reused"))


CLAIMS_SQL = f"{FILES}, claims AS (SELECT project_id, path AS file_path, regexp_extract(path, '_(\\d+)', 1)::INT AS ord, CASE WHEN length(content) % 4 = 0 THEN 'not in the code at all' ELSE replace(content[101:160], ' ', '  ') END AS quote, content FROM files WHERE length(content) > 200), v AS (SELECT project_id, ord, file_path, contains(trim(regexp_replace(content, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS ok FROM claims)"


def claims_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = files_of(spark, sf_dir).withColumnRenamed("path", "file_path")
    made = files.filter(F.length("content") > 200)
    quote = F.when(F.length("content") % 4 == 0, "not in the code at all").otherwise(F.replace(F.substring("content", 101, 60), F.lit(" "), F.lit("  ")))
    claims = made.select("project_id", F.regexp_extract("file_path", r"_(\d+)", 1).cast("int").alias("ord"), F.lit("security").alias("category"), F.lit("high").alias("severity"), F.lit("t").alias("title"), F.lit("d").alias("description"), "file_path", quote.alias("quote"))
    return claims, files.select("project_id", "file_path", "content", F.lit(1).alias("start_line"), text.line_count(F.col("content")).alias("end_line"))


@query(f"WITH {CLAIMS_SQL} SELECT project_id, ord, file_path FROM v WHERE ok")
def j9_verify_evidence(spark, sf_dir):
    return review.verify_evidence(*claims_of(spark, sf_dir))[0].select("project_id", "ord", "file_path")


@query(f"WITH {CLAIMS_SQL} SELECT project_id, count(*) AS dropped FROM v WHERE NOT ok GROUP BY project_id")
def c14_dropped_claims(spark, sf_dir):
    return review.verify_evidence(*claims_of(spark, sf_dir))[1].groupBy("project_id").agg(F.count("*").alias("dropped"))


def chunked(spark, sf_dir) -> DataFrame:
    return chunks.split_text(files_of(spark, sf_dir))


@query()
def w7_round_robin(spark, sf_dir):
    ranked = graph.kept(review.rank_chunks_in_file(chunked(spark, sf_dir)).select("project_id", "file_path", "seq", "turn", "risk"))
    return review.round_robin(ranked, review.interleave_dirs(review.rank_files(ranked))).select("project_id", "file_path", "seq", "queue")


@query()
def w9_review_sample(spark, sf_dir):
    return review.review_sample(chunked(spark, sf_dir)).select("project_id", "file_path", "seq", "chars")


@query()
def a35_sample_stats(spark, sf_dir):
    return evals.sample_stats(review.review_sample(chunked(spark, sf_dir)))


@query()
def c13_review_requests(spark, sf_dir):
    files = chunked(spark, sf_dir)
    projects = files.select("project_id").distinct().select("project_id", F.col("project_id").alias("name"), F.lit(None).cast("string").alias("framework"), F.sha2("project_id", 256).alias("boundary"))
    return review.review_requests(projects, files, "Review the code.").select("project_id", "tokens", "fits", F.sha2("prompt", 256).alias("prompt"))


LINKS = "e AS (SELECT DISTINCT (page_id % 10)::VARCHAR AS project_id, '/' || regexp_extract(html, '<title>(\\w+)', 1) AS source, target, page_id % 3 <> 0 AS facade, page_id % 7 = 0 AS from_test FROM (SELECT page_id, html, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1)) AS target FROM pages))"


def links_of(spark, sf_dir) -> DataFrame:
    """Pages as modules named by the first word of their title, links as imports; pages whose id is divisible by 7 stand for tests."""
    p = tables.read_table(spark, sf_dir, "pages")
    found = F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))
    return p.select((F.col("page_id") % 10).cast("string").alias("project_id"), F.concat(F.lit("/"), F.regexp_extract("html", r"<title>(\w+)", 1)).alias("source"), found.alias("target"), (F.col("page_id") % 3 != 0).alias("facade"), (F.col("page_id") % 7 == 0).alias("from_test")).distinct()


@query(f"WITH {LINKS} SELECT project_id, from_test, count(*) AS edges, count(DISTINCT target) AS targets FROM e GROUP BY ALL")
def c6_edges(spark, sf_dir):
    return links_of(spark, sf_dir).groupBy("project_id", "from_test").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


def reach_sql(where: str) -> str:
    return f"WITH RECURSIVE {LINKS}, r AS (SELECT DISTINCT project_id, target AS node FROM e WHERE from_test UNION SELECT e.project_id, e.target FROM r JOIN e ON e.project_id = r.project_id AND e.source = r.node WHERE NOT e.from_test{where}) SELECT project_id, node FROM r"


@query(reach_sql(""))
def c7_reachable(spark, sf_dir):
    return graph.reachable(graph.kept(links_of(spark, sf_dir)))


@query(reach_sql(" AND e.facade"))
def c7_reachable_facades(spark, sf_dir):
    return graph.reachable(graph.kept(links_of(spark, sf_dir)), facade_only=True)


@query(f"WITH {PATHS}, f AS (SELECT (page_id % 5)::VARCHAR AS project_id, path FROM paths), t AS (SELECT DISTINCT project_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '(?i)\\.(jsx?|tsx?)$', ''), '(?i)\\.test$', ''), '(?i)\\.spec$', ''), '/__tests__/', '/'), '/tests?/', '/') AS g FROM f WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.test\\.|\\.spec\\.') OR contains(path, '__tests__/')), s AS (SELECT DISTINCT project_id, path, regexp_replace(path, '(?i)\\.(jsx?|tsx?)$', '') AS b FROM f WHERE NOT (regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.test\\.|\\.spec\\.') OR contains(path, '__tests__/') OR regexp_matches(path, '(^|/)tests?/'))) SELECT DISTINCT s.project_id, s.path FROM s JOIN t ON s.project_id = t.project_id AND (ends_with(g, b) OR ends_with(b, g))")
def j11_tested_by_name(spark, sf_dir):
    f = paths_of(spark, sf_dir).select((F.col("page_id") % 5).cast("string").alias("project_id"), "path").distinct()
    is_test = paths.is_test_file(F.col("path"))
    return graph.tested_by_name(f.filter(~is_test), f.filter(is_test))


@query("WITH RECURSIVE p AS (SELECT DISTINCT (page_id % 5)::VARCHAR AS project_id, regexp_replace(regexp_extract(url, '://[^/]+/(.*)$', 1), '[?#].*$', '') AS path FROM pages), s AS (SELECT project_id, string_split(path, '/') AS a, path FROM p), n AS (SELECT DISTINCT project_id, array_to_string(a[1:k], '/') AS path, CASE WHEN k = len(a) THEN 'file' ELSE 'dir' END AS type, k::INT AS depth FROM s, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS k)) SELECT * FROM n")
def c9_file_tree(spark, sf_dir):
    url = F.regexp_replace(F.regexp_extract("url", "://[^/]+/(.*)$", 1), "[?#].*$", "")
    files = tables.read_table(spark, sf_dir, "pages").select((F.col("page_id") % 5).cast("string").alias("project_id"), url.alias("path")).distinct()
    return archives.file_tree(files).select("project_id", "path", "type", "depth")


@query(f"WITH {FILES} SELECT project_id, split_part(path, '/', 1) AS folder, count(*) AS files, sum(len(string_split(content, chr(10)))) AS lines, count(*) FILTER (WHERE regexp_matches(content, 'token')) AS tokens FROM files GROUP BY ALL")
def a33_code_profile(spark, sf_dir):
    return evals.code_profile(files_of(spark, sf_dir), {"tokens": "token"})


@query("WITH f AS (SELECT doc_id, quality = 0 AS wanted, regexp_matches(text, '[|#$%&*]|!!') AS found FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)), g AS (SELECT (doc_id % 4)::VARCHAR AS \"case\", sum(found::INT) AS found, sum(wanted::INT) AS wanted, sum((found AND wanted)::INT) AS hits FROM f GROUP BY ALL), u AS (SELECT * FROM g UNION ALL SELECT NULL, sum(found), sum(wanted), sum(hits) FROM g) SELECT \"case\", found, wanted, hits, CASE WHEN found = 0 THEN 1 ELSE hits / found END AS precision, CASE WHEN wanted = 0 THEN 1 ELSE hits / wanted END AS recall FROM u")
def a27_precision_recall(spark, sf_dir):
    """How well a rule for marks and shouts finds the documents of poor quality."""
    d = tables.read_table(spark, sf_dir, "documents").join(tables.read_table(spark, sf_dir, "labels").filter("quality IN (0, 1)"), "doc_id").withColumn("case", (F.col("doc_id") % 4).cast("string"))
    found, wanted = d.filter(F.col("text").rlike(r"[|#$%&*]|!!")), d.filter("quality = 0")
    return evals.precision_recall(d.select("case"), found, wanted, found.filter("quality = 0"))


@query("WITH k AS (SELECT conv_id AS c, turn AS run, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS keys FROM conversations WHERE turn < 4) SELECT a.c::VARCHAR AS \"case\", avg(CASE WHEN len(list_distinct(a.keys || b.keys)) = 0 THEN 1 ELSE len(list_intersect(a.keys, b.keys)) / len(list_distinct(a.keys || b.keys)) END) AS stability FROM k a JOIN k b ON a.c = b.c AND a.run < b.run GROUP BY a.c")
def a30_stability(spark, sf_dir):
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), "[^a-z]+", -1), ""))
    return evals.stability(tables.read_table(spark, sf_dir, "conversations").filter("turn < 4").select(F.col("conv_id").cast("string").alias("case"), F.col("turn").alias("run"), words.alias("keys")))


@query(ORACLE_SQL["a30_stability"].replace(" WHERE turn < 4", ""))
def a30_stability_whole(spark, sf_dir):
    """Of all turns."""
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), "[^a-z]+", -1), ""))
    return evals.stability(tables.read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("case"), F.col("turn").alias("run"), words.alias("keys")))
