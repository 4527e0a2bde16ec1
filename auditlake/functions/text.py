"""Functions of source text, findings and log fields. Every function takes and returns Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits of the rules.
SECRET_PATTERNS = [
    ("Hardcoded API key / token assignment", r"""(?i)\b(api[_-]?key|secret|token|password|private[_-]?key)\b\s*[:=]\s*['"][^'"\s]{8,}['"]"""),
    ("JWT-like secret literal", r"""(?i)\bjwt[_-]?secret\b\s*[:=]\s*['"][^'"]+['"]"""),
    ("AWS-style access key pattern", r"AKIA[0-9A-Z]{16}"),
]
RISK_SIGNALS = [
    r"\breq\.(body|query|params|headers|cookies)\b", r"\brequest\.(json|formData|text)\(", r"\bsearchParams\b|\bformData\.get\(", r"\beval\(|\bnew Function\(",
    r"\bchild_process\b|\bexecSync\(|\bexec\(|\bspawn\(", r"\$where\b|\.(query|execute|raw)\(|\$queryRawUnsafe|\$executeRawUnsafe",
    r"\.(select|insert|update|delete|upsert|findMany|findFirst|findUnique|findOne|insertOne|updateOne|deleteOne|aggregate)\(", r"\binnerHTML\b|dangerouslySetInnerHTML|document\.write\(",
    r"\bredirect\(", r"\bfetch\(|\baxios\b|\bhttps?\.(get|request)\(|\bneedle\b|\bgot\(", r"\bfs\.\w+\(|\breadFile(Sync)?\(|\bwriteFile(Sync)?\(",
    r"\bauth\w*\(|\bNextAuth\b|\bgetServerSession\b|\bcurrentUser\b|\bsignIn\(|\bauthorize\b", r"\bprocess\.env\b", r"(?i)\bpasswords?\b", r"(?i)\bsessions?\b", r"(?i)\bcookies?\b",
    r"(?i)\bjwt\b|\btokens?\b", r"\bcrypto\.|\bMath\.random\(",
]
#: For each risk signal, and for each secret pattern, words of which a match holds one; in small letters, where the pattern takes either case.
RISK_WORDS = [
    ["req."], ["request."], ["searchParams", "formData.get("], ["eval(", "new Function("], ["child_process", "exec", "spawn("], ["$where", "query", "execute", ".raw("], ["("], ["nnerHTML", "document.write("], ["redirect("],
    ["fetch(", "axios", "http", "needle", "got("], ["fs.", "readFile", "writeFile"], ["auth", "NextAuth", "getServerSession", "currentUser", "signIn("], ["process.env"], ["password"], ["session"], ["cookie"],
    ["jwt", "token"], ["crypto.", "Math.random("],
]
SECRET_WORDS = ["api", "secret", "token", "password", "private", "akia"]
REDACTED = "[REDACTED]"
LOG_SECRETS = [
    (r"(?i)(postgres(?:ql)?://)[^\s@/]+@", f"$1{REDACTED}@"), (r"(?i)\bBearer\s+[\w.~+/-]+=*", f"Bearer {REDACTED}"), (r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]+", REDACTED),
    (r"\bwhsec_[A-Za-z0-9]+", REDACTED), (r"\bgh[pousr]_[A-Za-z0-9]{20,}", REDACTED), (r"\bgsk_[A-Za-z0-9]{20,}", REDACTED),
]
PUBLIC_SECRETS = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----|$)", REDACTED), (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", REDACTED), (r"\bsk-[A-Za-z0-9_-]{20,}", REDACTED),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", REDACTED), (r"\bxox[abposr]-[A-Za-z0-9-]{10,}", REDACTED), (r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}", REDACTED),
    (r"""(?i)\b([\w.-]*(?:pass(?:word)?|secret|token|api[-_]?key|private[-_]?key|credential)[\w.-]*)(["'`]?\s*[:=]\s*)(["'`])[^"'`\n]{4,}\3""", f"$1$2$3{REDACTED}$3"),
]
SENSITIVE_KEY = r"(?i)pass(word)?|secret|token|api[-_]?key|authorization|cookie|credential|database_url|private[-_]?key"
IMPORT = r"""(?m)(?:^[ \t]*(?:import|export)\b[^;'"`]*?\bfrom\s*|^[ \t]*import\s*|\bimport\s*\(\s*|\brequire\s*\(\s*)["']([^"']+)["']"""
MOCK = r"""\b(?:vi|jest)\.mock\s*\(\s*["']([^"']+)["']"""
SEVERITIES = ["critical", "high", "medium", "low"]
PENALTIES = [20, 12, 6, 2]


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(value))).cast("int")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def severity_penalty(severity: Column) -> Column:
    return reduce(lambda c, pair: c.when(severity == pair[0], pair[1]), zip(SEVERITIES, PENALTIES, strict=True), F.when(F.lit(False), 0)).otherwise(0)


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def secret_hint(line: Column) -> Column:
    """The first secret pattern that a line matches; null for none."""
    return F.coalesce(*[F.when(line.rlike(pattern), F.lit(hint)) for hint, pattern in SECRET_PATTERNS])


def may_hold_secret(content: Column) -> Column:
    """Whether a text has a secret in one of its lines, or over several: lines need not be told apart where it has none."""
    return holds(F.lower(content), SECRET_WORDS) & secret_hint(content).isNotNull()


def holds(content: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [content.contains(w) for w in words])


def risk_score(content: Column) -> Column:
    """How many kinds of risk signal a text shows, not how often. Expressions are slow, so one is tried only where a word that it needs is found."""
    signals = [holds(F.lower(content) if p.startswith("(?i)") else content, words) & content.rlike(p) for p, words in zip(RISK_SIGNALS, RISK_WORDS, strict=True)]
    return reduce(Column.__add__, [s.cast("int") for s in signals])


def code_only(content: Column) -> Column:
    """Without comments, and with empty strings for string literals."""
    bare = F.regexp_replace(content, r"(?s)/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r"""(^|[^:"'`])//[^\n]*""", "$1")
    return F.regexp_replace(bare, r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", '""')


def specifiers(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(IMPORT), F.lit(1))


def mocks(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(MOCK), F.lit(1))


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def key_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def review_input_hash(model: Column, prompt_version: Column, project: Column, framework: Column, sample: Column) -> Column:
    """Identity of a review's input: model, prompt, project, framework and the sample (array of structs, in order)."""
    return F.sha2(F.to_json(F.struct(model.alias("model"), prompt_version.alias("prompt"), project.alias("project"), framework.alias("framework"), sample.alias("sample"))), 256)


def fnv1a32(col: Column) -> Column:
    """FNV-1a over code points, 32 bits, as 8 hex digits."""
    basis, prime, mask = 0x811C9DC5, 0x01000193, 0xFFFFFFFF
    chars = F.filter(F.split(col, "", -1), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(prime).cast("long")).bitwiseAND(F.lit(mask).cast("long"))
    return F.lower(F.lpad(F.hex(F.aggregate(chars, F.lit(basis).cast("long"), step)), 8, "0"))


def est_tokens(col: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(col) / 4)).cast("int")


def est_request_tokens(instructions: Column, prompt: Column) -> Column:
    return F.ceil((F.length(instructions) + F.length(prompt)) / 3).cast("int")


# Lengths that prompts are cut to, and what they say there.
CHUNK_CHARS, CUT_MARK, SNIPPET_OVERHEAD = 2500, "… [excerpt cut here]", 150
EXPLAIN_CHARS, EXPLAIN_MARK = 12_000, "\n\n/* truncated for analysis */"


def cut(col: Column, n: int, mark: str = "") -> Column:
    """The first n characters, with a mark where something was cut."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(mark))).otherwise(col)


def explain_cut(content: Column) -> Column:
    """A file as a question about it shows it."""
    return cut(content, EXPLAIN_CHARS, EXPLAIN_MARK)


def snippet_chars(content: Column, path: Column) -> Column:
    """Characters that a chunk takes in a review request."""
    return F.least(F.length(content), F.lit(CHUNK_CHARS)) + F.when(F.length(content) > CHUNK_CHARS, len(CUT_MARK) + 1).otherwise(0) + F.length(path) + SNIPPET_OVERHEAD


def collapse_ws(col: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)[\s﻿]+", " "), "^ | $", "")


def norm_path(col: Column) -> Column:
    """Null for an empty, blank or literal "null" path."""
    bare = F.regexp_replace(col, r"(?U)^[\s﻿]+|[\s﻿]+$", "")
    return F.when((bare != "") & (F.lower(bare) != "null"), bare)


def replaced(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.regexp_replace(c, pair[0], pair[1]), pairs, col)


def redact(col: Column) -> Column:
    return replaced(col, LOG_SECRETS)


def redact_public(col: Column) -> Column:
    return replaced(redact(col), PUBLIC_SECRETS)


def sanitize_fields(fields: Column, longest: int = 2000) -> Column:
    """A map of log fields: sensitive keys masked, other values redacted and cut."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit(REDACTED)).otherwise(cut(redact(v), longest, "…")))


#: Levels below the top that a log value may have, and how many items of a list are kept at each.
LOG_DEPTH, LOG_ITEMS, TRUNCATED = 4, 20, "[Truncated]"


def quoted(col: Column) -> Column:
    """A string in JSON."""
    return F.regexp_replace(F.to_json(F.array(col)), r"(?s)^\[|\]$", "")


def sanitize_value(value: Column, depth: int = 0, longest: int = 2000) -> Column:
    """A VARIANT as JSON, with sensitive keys masked and texts redacted and cut at every level; lists keep their first items, and what lies too deep is left out.

    Levels are bounded, so the walk is one expression: an object or a list becomes an array of entries, and each entry's value the same
    one level down. Keys of an object are in order, as VARIANT keeps them.
    """
    kind = F.schema_of_variant(value)
    is_object, is_list = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    scalar = F.when(kind == "STRING", quoted(cut(redact(F.try_variant_get(value, "$", "string")), longest, "…"))).when(kind.isNull() | (kind == "VOID"), F.lit("null")).otherwise(F.to_json(value))
    if depth > LOG_DEPTH:
        return F.when(is_object | is_list, F.lit(f'"{TRUNCATED}"')).otherwise(scalar)
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    items = F.transform(F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, LOG_ITEMS), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))

    def entry(e: Column) -> Column:
        name = F.when(e["key"].isNull(), F.lit("")).otherwise(F.concat(quoted(e["key"]), F.lit(":")))
        return F.concat(name, F.when(e["key"].rlike(SENSITIVE_KEY), F.lit(f'"{REDACTED}"')).otherwise(sanitize_value(e["value"], depth + 1, longest)))

    inner = F.array_join(F.transform(F.when(is_object, fields).otherwise(items), entry), ",")
    both = F.concat(F.when(is_object, "{").otherwise("["), inner, F.when(is_object, "}").otherwise("]"))
    return F.when(is_object | is_list, both).otherwise(scalar)


def sanitize_json(line: Column) -> Column:
    """A log line in JSON, sanitized at every level; a line that is none is redacted and cut as a text. Null stays null."""
    return F.when(line.isNull(), None).when(F.try_parse_json(line).isNull(), quoted(cut(redact(line), 2000, "…"))).otherwise(sanitize_value(F.try_parse_json(line)))


# What an answer's source files look like, names that are none, and phrases that say the sources fall short.
CITED_FILE = r"[\w@.\[\]/-]+\.(?:[cm]?[jt]sx?)\b"
LIBRARY_NAME = r"(?i)^(node|next|nuxt|nest|vue|react|express|angular|ember|backbone|three|d3|chart|socket\.io)\.js$"
SOURCES = "(?:sources|snippets|code|files|repository|project)"
FALL_SHORT = [
    f"not (?:in|included in|present in|shown in|part of|covered by|found in) the (?:provided |retrieved )?{SOURCES}",
    f"{SOURCES}(?: (?:you |that were |that you )?(?:provided|retrieved|shared|given)| you've shown| you have shown)? (?:do(?:es)? not|don't|doesn't) (?:show|contain|include|mention|cover|define|reference)",
    "no (?:relevant )?(?:code|sources?|snippets?|mention|reference)", "insufficient", "(?:cannot|can't|could not|couldn't) (?:find|determine|tell|see|show|locate|answer)",
    "not enough (?:information|context)", "there is no",
]


def plain_marks(col: Column) -> Column:
    """Typographic hyphens and apostrophes as plain ones."""
    return F.regexp_replace(F.regexp_replace(col, "[\u2010-\u2015\u2212]", "-"), "[\u2018\u2019\u02bc]", "'")


def citations(answer: Column) -> Column:
    """Distinct source files that an answer cites, as written; names of libraries are left out."""
    found = F.regexp_extract_all(plain_marks(answer), F.lit(f"({CITED_FILE})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"\.$", "")), lambda p: ~p.rlike(LIBRARY_NAME)))


def abstains(answer: Column) -> Column:
    """Whether an answer says that its sources fall short."""
    return plain_marks(answer).rlike("(?i)" + "|".join(FALL_SHORT))


def quota_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def older_than(ts: Column, now: Column, seconds: int) -> Column:
    return ts < now - F.make_interval(secs=F.lit(seconds))


def score_tone(score: Column) -> Column:
    return F.when(score.isNull(), "neutral").when(score >= 75, "good").when(score >= 50, "ok").otherwise("poor")


# How prompts mark data.
DATA_BEGIN, DATA_END = "<<<DATA ", ">>>"


def data_block(header: Column, body: Column, boundary: Column) -> Column:
    """Untrusted text, its header too, between marks that it cannot forge, as it does not know the boundary."""
    return F.concat_ws("\n", F.concat(F.lit(DATA_BEGIN), boundary), header, body, F.concat(F.lit("DATA "), boundary, F.lit(DATA_END)))


def line_range(start: Column, end: Column, unknown: str = "lines unknown") -> Column:
    """`L1-L9`, where both lines are known (counted from 1)."""
    return F.when((F.coalesce(start, F.lit(0)) > 0) & (F.coalesce(end, F.lit(0)) > 0), F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(F.lit(unknown))
