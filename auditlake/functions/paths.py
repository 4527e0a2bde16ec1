"""What a file is, from its path alone. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and words that decide how a path is treated.
SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx"]
EXCLUDED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", "coverage", ".turbo", ".vercel", ".data", ".nuxt", ".output", ".svelte-kit", ".docusaurus", ".expo", ".cache", ".parcel-cache", ".yarn",
    "third_party", "third-party", "bower_components", ".claude", ".cursor", ".vscode", ".idea", ".husky",
]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb"]
STATIC_DIRS = ["assets", "public", "static"]
SENSITIVE_FILES = [".npmrc", ".yarnrc.yml", ".netrc", ".pypirc", ".htpasswd", "credentials.json", "service-account.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SENSITIVE_EXTENSIONS = ["pem", "key", "p12", "pfx", "jks", "keystore"]
BINARY_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "pdf", "zip", "gz", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "wasm", "exe", "dll", "so", "dylib"]
SERVER_WORDS = [
    "api", "route", "routes", "server", "action", "actions", "auth", "db", "database", "query", "queries", "payment", "payments", "billing", "webhook", "webhooks", "middleware", "proxy", "session", "admin",
    "controller", "controllers", "handler", "handlers",
]
CRITICAL_WORDS = ["auth", "payment", "billing", "password", "token"]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """With its closing slash; empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1))


def strip_ext(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.(jsx?|tsx?)$", "")


def module_key(path: Column) -> Column:
    """How imports name a file: without extension and without a closing `/index`."""
    return F.regexp_replace(strip_ext(path), "/index$", "")


def is_facade(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(index|server)\.[jt]sx?$")


def path_words(path: Column) -> Column:
    """Lower-cased words, split at separators and at a capital after a small letter or digit."""
    spaced = F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.array_remove(F.split(spaced, r"[/._\-\s]+", -1), "")


def is_test_file(path: Column) -> Column:
    base = F.lower(basename(path))
    return base.contains(".test.") | base.contains(".spec.") | path.contains("__tests__/") | path.rlike("(^|/)tests?/")


def is_test_support(path: Column) -> Column:
    return path.rlike("(^|/)(__fixtures__|fixtures|__mocks__)/")


def guess_source(path: Column) -> Column:
    """The source path, without extension, that a test file's own path points at."""
    bare = F.regexp_replace(F.regexp_replace(strip_ext(path), r"(?i)\.test$", ""), r"(?i)\.spec$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^(.*?)/__tests__/", "$1/"), "^(.*?)/tests?/", "$1/")


def is_source_file(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def normalise(path: Column) -> Column:
    """Forward slashes, single ones, no leading `./`."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def is_safe(path: Column) -> Column:
    """Whether a path from an archive stays below the root it is unpacked to."""
    p = normalise(path)
    return ~(p.contains("\x00") | p.startswith("/") | p.rlike("^[a-zA-Z]:") | F.array_contains(F.split(p, "/", -1), ".."))


def keep_path(path: Column) -> Column:
    """Whether an entry may be read at all: safe, and not generated, third-party, secret-bearing or binary."""
    p = normalise(path)
    parts = F.split(F.lower(p), "/", -1)
    base = F.element_at(parts, -1)
    ext = extension(p)
    vendor = F.exists(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (F.get(parts, i) == "vendor") & ((i == 0) | F.arrays_overlap(F.slice(parts, F.lit(1), i), strings(STATIC_DIRS))))
    skip = (
        (p == "") | p.endswith("/") | ~is_safe(path) | F.arrays_overlap(parts, strings(EXCLUDED_DIRS)) | vendor | base.isin(*LOCK_FILES) | base.rlike(r"\.min\.[cm]?js$")
        | (base == ".env") | base.startswith(".env.") | base.isin(*SENSITIVE_FILES) | ext.isin(*SENSITIVE_EXTENSIONS) | ext.isin(*BINARY_EXTENSIONS)
    )
    return F.coalesce(~skip, F.lit(False))


def is_ui_file(path: Column) -> Column:
    return path.rlike(r"(?i)\.[jt]sx$|\.component\.[jt]s$") | path.rlike("(?i)^(frontend|client)/") | path.rlike("(?i)(^|/)(static|public|assets)/")


def path_priority(path: Column) -> Column:
    """0 server logic, 1 other logic, 2 UI, 3 configuration and type declarations."""
    return (
        F.when(path.rlike(r"(?i)\.config\.[cm]?[jt]s$|\.d\.ts$"), 3).when(is_ui_file(path), 2)
        .when(F.arrays_overlap(path_words(path), strings(SERVER_WORDS)), 0).otherwise(1)
    )


def is_critical(path: Column) -> Column:
    """Security or payment logic by a whole word of the path; screens are not."""
    words = strings(CRITICAL_WORDS + [w + "s" for w in CRITICAL_WORDS])
    return ~path.rlike(r"(?i)\.[jt]sx$") & F.arrays_overlap(path_words(path), words)


def resolve_import(path: Column, specifier: Column) -> Column:
    """The path, without extension, that a relative or `@/` import names; null for packages."""
    start = F.split(F.regexp_replace(dirname(path), "/$", ""), "/", -1)
    start = F.array_remove(start, "")
    steps = F.split(specifier, "/", -1)
    walked = F.aggregate(steps, start, lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    return (
        F.when(specifier.startswith("@/"), strip_ext(F.concat(F.lit("src/"), F.substr(specifier, F.lit(3)))))
        .when(specifier.startswith("./") | specifier.startswith("../"), strip_ext(F.array_join(walked, "/")))
    )


def repo_full_name(name: Column, url: Column) -> Column:
    """`owner/repo` from a name of that form, else from a repository URL."""
    own = F.regexp_extract(name, r"^([\w.-]+/[\w.-]+)$", 1)
    linked = F.regexp_extract(url, r"github\.com/([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(linked, F.lit("")))
