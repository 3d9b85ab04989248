"""Deduplication, severity buckets and the counters derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintharbor import schemas
from lintharbor.functions import severity as sev
from lintharbor.functions import text as tx
from lintharbor.functions.scale import first_per_key, join_per_project
from lintharbor.operators.registry import TOOLS, Tool, scan_label, scan_name, scan_order  # noqa: F401
from lintharbor.sources import report_pass as rpp
from lintharbor.sources import reports as rp

KEYS = schemas.SCAN_KEYS


def fingerprint() -> Column:
    return tx.fingerprint(F.col("file"), F.col("line"), F.col("tool"), F.col("rule_id"),
                          F.col("title"))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint())


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per fingerprint of a scan, whole rows.

    The shuffle key is the fingerprint, not the project, and map tasks already keep one row per
    key, so neither a huge project nor a huge group of copies lands in one task.
    """
    return first_per_key(with_fingerprint(findings), [*KEYS, "fingerprint"]).drop("fingerprint")


# Bucket order packed into integers, so that the fingerprint-level aggregate keeps fixed-width
# buffers and stays a hash aggregate.
_CODE = {b: i for i, b in enumerate(sev.BUCKETS)}


def fingerprint_groups(findings: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per fingerprint: the first finding's bucket plus counts of all copies."""
    bucket = sev.severity_bucket(F.col("severity"))
    return (
        findings.select(
            *KEYS, *extra_keys, "seq", fingerprint().alias("fingerprint"),
            sev.bucket_rank(bucket).alias("code"),
            (F.col("tool") == "Secret Scanner").alias("is_secret"),
            F.col("tool").isin("pip-audit", "npm audit").alias("is_dependency"))
        .groupBy(*KEYS, *extra_keys, "fingerprint")
        .agg(F.min_by("code", "seq").alias("code"),
             F.count_if("is_secret").alias("n_secrets"),
             F.count_if("is_dependency").alias("n_dependencies"))
    )


def severity_buckets(findings: DataFrame) -> DataFrame:
    """Four counts per scan after deduplication, plus the counters taken before it.

    Both come from one pass: copies are counted while their fingerprint is folded.
    """
    code = F.col("code")
    return (
        fingerprint_groups(findings).groupBy(*KEYS)
        .agg(*[F.count_if(code == i).alias(f"{b}_count") for b, i in _CODE.items()],
             F.count(F.lit(1)).alias("total"),
             F.sum("n_secrets").alias("secrets_found"),
             F.sum("n_dependencies").alias("outdated_dependencies"))
    )


def bandit_breakdown(items: DataFrame) -> DataFrame:
    """Counts per run; levels other than the three named are ignored."""
    level = F.upper(F.coalesce("issue_severity", F.lit("UNKNOWN")))
    return items.groupBy(*rp.RUN_KEYS).agg(
        *[F.count_if(level == n).alias(n.lower()) for n in ("HIGH", "MEDIUM", "LOW")])


def semgrep_breakdown(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per run; an unknown level counts as medium."""
    level = F.lower(F.coalesce("severity", F.lit("medium")))
    other = ~level.isin("critical", "high", "low")
    return items.groupBy(*(keys or rp.RUN_KEYS)).agg(
        F.count_if(level == "critical").alias("critical"),
        F.count_if(level == "high").alias("high"),
        F.count_if(other).alias("medium"),
        F.count_if(level == "low").alias("low"))


def taint_count(items: DataFrame) -> DataFrame:
    return items.groupBy(*KEYS).agg(F.count_if("is_taint_finding").alias("taint_findings"))


def semgrep_multi_config(tagged: DataFrame) -> DataFrame:
    """Runs of several rule sets over one target as one result, in counts.

    `tagged` is a written report pass; `report_pass.merged_flow` gives the findings, paths and errors
    that are counted here. `n_errors` counts the errors the result lists, at most ten a run,
    `n_errors_total` all of them.
    """
    merged, _, _ = rpp.merged_flow(tagged)
    found = semgrep_breakdown(merged, KEYS).withColumn(
        "total_issues", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))
    rows = tagged.filter(F.col("tool") == "Semgrep")
    paths = rpp.of_kind(rows.filter("failure IS NULL"), "path").groupBy(*KEYS).agg(
        F.count_distinct("path").alias("files_scanned"))
    ok, n = F.col("failure").isNull(), F.col("n_errors")
    failed = ~ok & ~F.col("failure").contains("not installed")
    # A row for every scan with a run, clean or not.
    errors = rpp.of_kind(rows, "run").groupBy(*KEYS).agg(
        F.sum(F.when(ok, F.least(n, F.lit(10))).when(failed, 1).otherwise(0)).alias("n_errors"),
        F.sum(F.when(ok, n).when(failed, 1).otherwise(0)).alias("n_errors_total"))
    return errors.join(found, KEYS, "left").join(paths, KEYS, "left").fillna(0)


def files_scanned(runs: DataFrame) -> DataFrame:
    """Files as the report counts them, once per tool, and the distinct paths of the data-flow scans."""
    done = runs.filter(F.col("exit_code").isin(0, 1))
    distinct = rp.scanned_paths(done).groupBy(*KEYS).agg(
        F.count_distinct("path").alias("files_distinct"))
    return run_facts(runs).select(*KEYS, "files_scanned").join(distinct, KEYS, "left").fillna(
        0, ["files_distinct"])


def secret_and_dependency_counts(findings: DataFrame) -> DataFrame:
    """Counters over all findings, copies included."""
    return findings.groupBy(*KEYS).agg(
        F.count_if(F.col("tool") == "Secret Scanner").alias("secrets_found"),
        F.count_if(F.col("tool").isin("pip-audit", "npm audit")).alias("outdated_dependencies"))


def elapsed(runs: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Seconds in which at least one run of a scan was under way: runs that overlap count once.

    `runs` has started_at and ended_at; runs without both count nothing. Runs are cut at the borders of
    buckets of time, so that a long scan with very many runs is merged by many tasks: within a bucket, a
    run adds what lies behind the latest end of all runs that began before it.
    """
    begin, end = (F.col(c).cast("timestamp").cast("double") for c in ("started_at", "ended_at"))
    spans = runs.select(*KEYS, begin.alias("_a"), end.alias("_b")).filter("_b > _a")
    cut = (
        spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket_s), F.floor(F.col("_b") / bucket_s))))
        .withColumns({"_a": F.greatest("_a", F.col("_bucket") * bucket_s),
                      "_b": F.least("_b", (F.col("_bucket") + 1) * bucket_s)}))
    before = Window.partitionBy(*KEYS, "_bucket").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.greatest("_a", F.coalesce(F.max("_b").over(before), F.col("_a")))
    return cut.withColumn("_new", F.greatest(F.lit(0.0), F.col("_b") - behind)).groupBy(*KEYS).agg(
        F.sum("_new").alias("elapsed_s"))


def run_facts(runs: DataFrame, languages: DataFrame | None = None, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """Run-level facts per scan: names, files and seconds.

    `runs` is a run table or the run rows of a report pass. `languages` (project, typescript) says which
    projects hold TypeScript; without it the files the script scanner was given do. `duration_s` adds up
    the seconds of all runs, `elapsed_s` is the time they took together where runs say when they ran.
    """
    tool = F.col("tool")
    known = [t.name for t in tools if t.label]
    ran = F.collect_set(F.when(
        tool.isin(*known), F.struct(scan_order(tool, tools).alias("o"), tool.alias("t"))))
    has_ts = F.bool_or((tool == "ESLint") & F.col("unit").rlike(r"\.tsx?$"))
    n_paths = F.col("n_paths") if "n_paths" in runs.columns else rp.n_scanned_paths(F.col("stdout"))
    per_run = (
        F.when(tool.isin("Bandit", "ESLint"), F.coalesce("file_count", F.lit(0)))
        .when(tool == "Semgrep", n_paths).otherwise(0))
    facts = runs.groupBy(*KEYS).agg(
        F.sort_array(ran).alias("ran"), F.coalesce(has_ts, F.lit(False)).alias("has_ts"),
        F.sum(F.when(rp.succeeded(F.col("exit_code")), per_run).otherwise(0)).alias("files_scanned"),
        F.sum("duration_s").alias("duration_s"))
    if languages is not None:
        flags = languages.groupBy("project").agg(F.bool_or("typescript").alias("_ts"))
        facts = join_per_project(facts, flags, ["project"], "left", spread_by=["scan_id"]).withColumn(
            "has_ts", F.coalesce("_ts", F.lit(False))).drop("_ts")
    if {"started_at", "ended_at"} <= set(runs.columns):
        facts = facts.join(elapsed(runs), KEYS, "left").fillna(0.0, ["elapsed_s"])
    else:
        facts = facts.withColumn("elapsed_s", F.col("duration_s"))
    names = F.transform("ran", lambda x: scan_name(x["t"], F.col("has_ts"), tools))
    return facts.select(*KEYS, F.size("ran").alias("n_scans"), names.alias("scans_performed"),
                        "files_scanned", "duration_s", "elapsed_s")


def scans_performed(runs: DataFrame, languages: DataFrame | None = None, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """Names of the scans that ran, failed ones included, each once."""
    return run_facts(runs, languages, tools).select(*KEYS, "n_scans", "scans_performed")


def total_issues(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*KEYS, "tool").agg(F.count(F.lit(1)).alias("total_issues"))


def secret_type_rollup(secrets: DataFrame) -> DataFrame:
    """Hits and distinct files per project and secret type."""
    return secrets.groupBy("project", "title").agg(
        F.count(F.lit(1)).alias("n_secrets"), F.count_distinct("path").alias("n_files"))
