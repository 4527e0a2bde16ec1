"""Archives of source code: entries, filters, limits, texts.

Entries: project_id, entry_path, size_bytes, bytes, verdict (ok, too_large, corrupt, too_many_entries).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths

MAX_ENTRIES, MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 50_000, 1000, 100 << 20, 500 << 10
#: Bytes of all entries, also those that are filtered later, after which an archive is not read on.
READ_BYTES = 16 * MAX_BYTES
ENTRY = "project_id string, entry_path string, size_bytes long, bytes binary, verdict string"


def named(path: str, root: str) -> str:
    """A project's name: its archive's path below the folder that is read, without the ending; so equal names in two folders are two projects."""
    folder = root.rstrip("/").split("://")[-1]
    below = path.split(folder + "/", 1)[-1] if folder and "*" not in folder and folder + "/" in path else path
    return below.removesuffix(".zip")


def unzip(frames: Iterator[pd.DataFrame], root: str = "") -> Iterator[pd.DataFrame]:
    """Entries of archives, read up to the cap of a file: what an entry's header says of its size is not believed.

    An archive of which more than the cap of a project has been read is read no further.
    """
    cols = ENTRY.split(", ")
    names = [c.split()[0] for c in cols]
    for f in frames:
        for path, content in zip(f["path"], f["content"], strict=True):
            project, total = named(path, root), 0
            held: list[tuple] = []
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                entries = archive.infolist()
                if len(entries) > MAX_ENTRIES:
                    yield pd.DataFrame([(project, None, None, None, "too_many_entries")], columns=names)
                    continue
                for e in entries:
                    if e.is_dir() or (e.external_attr >> 16) & 0o170000 == 0o120000:
                        continue
                    with archive.open(e) as stream:
                        body = stream.read(MAX_FILE_BYTES + 1)
                    large = len(body) > MAX_FILE_BYTES
                    total += len(body)
                    if total > READ_BYTES:
                        held.append((project, None, total, None, "too_large_archive"))
                        break
                    held.append((project, e.filename, len(body), None if large else body, "too_large" if large else "ok"))
                    if len(held) >= 200:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
                held.append((project, None, None, None, "corrupt"))
            if held:
                yield pd.DataFrame(held, columns=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all ZIP archives below a path, one task per archive or more archives a task; a project is named by its archive's path below that."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")
    return held.mapInPandas(lambda frames: unzip(frames, path), ENTRY)


def strip_common_root(entries: DataFrame) -> DataFrame:
    """Paths without their first folder, in projects whose entries all share one."""
    top = F.substring_index("entry_path", "/", 1)
    roots = entries.filter("entry_path IS NOT NULL").groupBy("project_id").agg((F.min(top) == F.max(top)).alias("_one"), F.min(F.size(F.split("entry_path", "/"))).alias("_depth"))
    joined = entries.hint("merge").join(roots.hint("merge"), "project_id", "left")
    bare = F.when(F.col("_one") & (F.col("_depth") > 1), F.expr("substring(entry_path, length(substring_index(entry_path, '/', 1)) + 2)")).otherwise(F.col("entry_path"))
    return joined.withColumn("entry_path", bare).drop("_one", "_depth")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType())])))
def ignore_rules(content: pd.Series) -> pd.Series:
    """The patterns of an ignore file as regular expressions over relative paths, in order."""

    def parse(body: str | None) -> list[dict]:
        out = []
        for line in (body or "").splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            pattern = line[negated:].removeprefix("\\")
            folder, pattern = pattern.endswith("/"), pattern.rstrip("/")
            anchored, pattern = "/" in pattern, pattern.lstrip("/")
            made, i = "", 0
            while i < len(pattern):
                if pattern.startswith("**/", i):
                    made, i = made + "(?:.*/)?", i + 3
                elif pattern.startswith("**", i):
                    made, i = made + ".*", i + 2
                else:
                    c = pattern[i]
                    made += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]" or c.isalnum() else "\\" + c
                    i += 1
            if pattern:
                out.append({"ord": len(out), "regex": ("^" if anchored else "(?:^|.*/)") + made + ("/.*" if folder else "(?:/.*)?") + "$", "negated": negated})
        return out

    return content.map(parse)


def ignore_patterns(files: DataFrame) -> DataFrame:
    """project_id, ord, regex, negated of each project's root ignore file (project_id, path, content)."""
    return files.filter("path = '.gitignore'").select("project_id", F.explode(ignore_rules("content")).alias("p")).select("project_id", "p.*")


def apply_ignore(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that the last pattern matching them does not exclude."""
    hit = files.select("project_id", "path").hint("merge").join(patterns.hint("merge"), "project_id").filter(F.expr("path RLIKE regex")).groupBy("project_id", "path").agg(F.max_by("negated", "ord").alias("_kept"))
    return files.hint("merge").join(hit.filter("NOT _kept").hint("merge"), ["project_id", "path"], "left_anti")


def decode_text(entries: DataFrame) -> DataFrame:
    """project_id, path, content, size_bytes of the entries that are text."""
    made = entries.filter("verdict = 'ok'").select("project_id", paths.normalise(F.col("entry_path")).alias("path"), F.decode("bytes", "UTF-8").alias("content"), "size_bytes")
    return made.filter(~F.col("content").contains("\x00"))


def import_verdict(entries: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """project_id, ok, error, total_bytes, skipped_large of each project's entries, without those that its ignore file (`patterns`) leaves out.

    Source files count towards the limit whatever their size; the bytes are those of what is read, manifests included.
    """
    if patterns is not None:
        entries = apply_ignore(entries.withColumn("path", paths.normalise(F.coalesce("entry_path", F.lit("")))), patterns).drop("path")
    kept = F.coalesce(paths.keep_path(F.col("entry_path")), F.lit(False))
    source = kept & paths.is_source_file(F.col("entry_path"))
    read = (source | (kept & (paths.basename(F.col("entry_path")) == "package.json"))) & (F.col("verdict") == "ok")
    sums = entries.groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "corrupt").alias("bad"), F.count_if(F.col("verdict") == "too_many_entries").alias("many"), F.count_if(source).alias("sources"), F.count_if(read & source).alias("usable"), F.count_if(F.col("verdict") == "too_large_archive").alias("huge"),
        F.coalesce(F.sum(F.when(read, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"), F.count_if(source & (F.col("verdict") == "too_large")).alias("skipped_large"))
    error = (
        F.when(F.col("bad") > 0, "corrupt archive").when((F.col("many") > 0) | (F.col("n") > MAX_ENTRIES), "too many entries").when(F.col("sources") > MAX_FILES, "too many source files")
        .when((F.col("total_bytes") > MAX_BYTES) | (F.col("huge") > 0), "too large").when(F.col("usable") == 0, "no source files")
    )
    return sums.select("project_id", error.isNull().alias("ok"), error.alias("error"), "total_bytes", "skipped_large")


# Dependencies and configuration files that name a framework, in order.
FRAMEWORKS = [("next", "Next.js"), ("nuxt", "Nuxt"), ("remix", "Remix"), ("@remix-run/react", "Remix"), ("astro", "Astro"), ("@nestjs/core", "NestJS"), ("express", "Express"), ("fastify", "Fastify"), ("vue", "Vue"), ("react", "React")]
CONFIGS = [("next.config", "Next.js"), ("nuxt.config", "Nuxt"), ("astro.config", "Astro")]


def shallowest(files: DataFrame, name: str = "package.json") -> DataFrame:
    """project_id, content of the file of that name that is least deep, the first by path of equals."""
    named = files.filter(paths.basename(F.col("path")) == name)
    return named.groupBy("project_id").agg(F.min_by("content", F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("content"))


def detect_framework(files: DataFrame, all_paths: DataFrame) -> DataFrame:
    """project_id, framework: by the manifest's dependencies, else by names of configuration files, else by language."""
    deps = shallowest(files).select("project_id", F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]).alias("deps"))
    config = lambda stem: F.max(paths.basename(F.col("path")).rlike("^" + stem.replace(".", r"\.") + r"\.(js|mjs|cjs|ts|mts)$"))
    seen = all_paths.groupBy("project_id").agg(*[config(stem).alias(f"c{i}") for i, (stem, _) in enumerate(CONFIGS)], F.max(F.col("path").rlike(r"\.tsx?$")).alias("ts"), F.max(F.col("path").rlike(r"\.jsx?$")).alias("js"))
    joined = seen.hint("merge").join(deps.hint("merge"), "project_id", "left")
    by_deps = F.coalesce(*[F.when(F.array_contains("deps", d), F.lit(name)) for d, name in FRAMEWORKS])
    by_config = F.coalesce(*[F.when(F.col(f"c{i}"), F.lit(name)) for i, (_, name) in enumerate(CONFIGS)])
    return joined.select("project_id", F.coalesce(by_deps, by_config, F.when(F.col("ts"), "TypeScript").when(F.col("js"), "JavaScript").otherwise("Unknown")).alias("framework"))


def file_tree(files: DataFrame) -> DataFrame:
    """project_id, path, parent, name, type, depth of all files and their folders, folders first and then by name."""
    parts = F.split("path", "/")
    folders = files.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), F.when(n == F.size(parts), "file").otherwise("dir").alias("type"), n.alias("depth")))).alias("n"))
    rows = folders.select("project_id", "n.*").distinct()
    first = Window.partitionBy("project_id", "parent").orderBy(F.col("type") != "dir", F.collate("name", "UNICODE"))
    return rows.withColumns({"parent": F.regexp_replace(paths.dirname(F.col("path")), "/$", ""), "name": paths.basename(F.col("path"))}).withColumn("place", F.row_number().over(first))
