"""File inventory: what exists per project, what is excluded, which scans apply."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.functions import text as tx
from lintharbor.functions.scale import join_per_project
from lintharbor.sources.walk import contents, walk

# Directory names that are never scanned.
EXCLUDED_DIRS = [
    "node_modules", ".git", "__pycache__", "venv", "env", ".venv", "dist", "build",
    ".pytest_cache", ".mypy_cache", "coverage", "htmlcov", ".tox", "site-packages",
]
# Dependency manifests in the order they are audited.
MANIFESTS = ["requirements.txt", "requirements-dev.txt", "pyproject.toml"]
ESLINT_IGNORED = ["node_modules", "dist", "build"]


FOUND = "project string, root string, path string"


def plain_path(path: Column) -> Column:
    """Path without scheme and authority: however a folder was named, paths below it start alike."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?/*", "/")


def list_files(spark: SparkSession, path: str, project: str, hidden: bool = True,
               skip: Collection[str] = tuple(EXCLUDED_DIRS)) -> DataFrame:
    """Paths below `path`, folder by folder in the tasks; folders named in `skip` are never entered.

    `hidden` keeps the files whose name Spark's own listing leaves out (`__init__.py`, `.env`).
    """
    roots = spark.createDataFrame([(project, path)], "project string, root string")
    return walk(roots, skip, hidden).select("project", "root", "path")


def read_text_files(spark: SparkSession, path: str, project: str, hidden: bool = True,
                    skip: Collection[str] = tuple(EXCLUDED_DIRS)) -> DataFrame:
    """Whole text files below `path`, one row each; `hidden` and `skip` as for `list_files`."""
    roots = spark.createDataFrame([(project, path)], "project string, root string")
    return contents(walk(roots, skip, hidden)).select("project", "root", "path", "text")


def source_texts(texts: DataFrame, exclude: DataFrame | None = None, include: DataFrame | None = None) -> DataFrame:
    """What detection reads of `read_text_files`: no excluded folder, the globs of the project applied.

    Files of no known language stay, as secrets can be in any of them.
    """
    kept = inventory(texts).filter(~F.col("excluded_dir"))
    kept = exclude_globs(kept, exclude) if exclude is not None else kept
    return include_patterns(kept, include) if include is not None else kept


def language_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(name, r"\.([a-z]+)$", 1)
    return (
        F.when(name == "package.json", "package_json")
        .when(ext == "py", "python")
        .when(ext.isin("js", "jsx"), "javascript")
        .when(ext.isin("ts", "tsx"), "typescript")
    )


def inventory(files: DataFrame) -> DataFrame:
    """Adds rel_path, name, language and the directory exclusion to (project, root, path).

    Exclusion looks at the path below the root, so a project that itself lives under a folder
    named `build` is still scanned. A path outside its root keeps its full length.
    """
    path, root = plain_path(F.col("path")), plain_path(F.rtrim("root", F.lit("/")))
    base = F.concat(root, F.lit("/"))
    rel = (F.when(path.startswith(base), F.substr(path, F.length(base) + 1))
           .when(path == root, tx.base_name(path)).otherwise(path))
    return (
        files.withColumn("rel_path", rel)
        .withColumn("name", F.substring_index("path", "/", -1))
        # A target that is itself a package.json is no Node project.
        .withColumn("language", F.when(
            (path != root) | (F.col("name") != "package.json"),
            language_of(F.col("path"))))
        .withColumn("excluded_dir", F.arrays_overlap(
            F.split("rel_path", "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS])))
    )


def with_glob_match(inv: DataFrame, globs: DataFrame, out: str) -> DataFrame:
    """`out`: does a glob of the project (project, globs) match the full or the relative path.

    The pattern text is built once per project, before the join.
    """
    patterns = globs.select("project", tx.any_glob_regex(F.col("globs")).alias("_rx"))
    hit = F.rlike(F.col("path"), F.col("_rx")) | F.rlike(F.col("rel_path"), F.col("_rx"))
    return (
        join_per_project(inv, patterns, ["project"], "left", spread_by=["path"])
        .withColumn(out, hit).drop("_rx")
    )


def exclude_globs(inv: DataFrame, globs: DataFrame) -> DataFrame:
    return with_glob_match(inv, globs, "_hit").filter(~F.coalesce("_hit", F.lit(False))).drop("_hit")


def include_patterns(inv: DataFrame, globs: DataFrame) -> DataFrame:
    """Positive counterpart; a project without include globs keeps everything."""
    return with_glob_match(inv, globs, "_hit").filter(F.coalesce("_hit", F.lit(True))).drop("_hit")


def included(inv: DataFrame) -> DataFrame:
    """The source files every scan works on."""
    return inv.filter(~F.col("excluded_dir") & F.col("language").isNotNull())


def eslint_files(inv: DataFrame) -> DataFrame:
    """Files the JavaScript scanner itself looks at, by its own ignore list."""
    ignored = F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(d) for d in ESLINT_IGNORED]))
    return inv.filter(F.col("language").isin("javascript", "typescript") & ~ignored)


def typescript_outside_node_modules(inv: DataFrame) -> DataFrame:
    ts = (F.col("language") == "typescript") & ~F.col("path").contains("node_modules")
    return inv.groupBy("project").agg(
        F.coalesce(F.bool_or(ts), F.lit(False)).alias("has_typescript"))


def project_languages(files: DataFrame) -> DataFrame:
    """Language flags and file counts per project; TypeScript implies JavaScript."""
    def n(name: str) -> Column:
        return F.count_if(F.col("language") == name)

    counted = files.groupBy("project").agg(
        n("python").alias("python_files"), n("javascript").alias("js_files"),
        n("typescript").alias("ts_files"), n("package_json").alias("package_json_files"))
    return counted.select(
        "project",
        (F.col("python_files") > 0).alias("python"),
        ((F.col("js_files") > 0) | (F.col("ts_files") > 0)).alias("javascript"),
        (F.col("ts_files") > 0).alias("typescript"),
        (F.col("package_json_files") > 0).alias("nodejs"),
        "python_files", "js_files", "ts_files", "package_json_files",
    )


def dependency_manifests(inv: DataFrame) -> DataFrame:
    """Top-level manifests per project in audit order; a project without any has an empty list."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col("rel_path"))
    found = inv.groupBy("project").agg(
        F.sort_array(F.collect_set(F.when(rank > 0, F.struct(rank.alias("r"), "rel_path")))).alias("m"))
    return found.select(
        "project", F.transform("m", lambda x: x["rel_path"]).alias("manifests"),
        F.size("m").alias("n_manifests"))


def npm_project_dirs(files: DataFrame) -> DataFrame:
    """One audit unit per included package.json."""
    return (
        files.filter(F.col("language") == "package_json")
        .select("project", F.regexp_replace("path", r"/package\.json$", "").alias("project_dir"))
        .distinct()
    )


def distinct_paths(paths: DataFrame) -> DataFrame:
    return paths.select("project", "scan_id", "path").distinct()
