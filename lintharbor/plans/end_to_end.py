"""From tool runs to findings, summaries and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import text as tx
from lintharbor.functions.scale import join_per_project, stored
from lintharbor.operators import policy as po
from lintharbor.operators import risk
from lintharbor.operators import rollup as ru
from lintharbor.operators.policy import DEFAULTS
from lintharbor.operators.registry import TOOLS, Tool
from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks import html, json_doc, sarif
from lintharbor.sinks.pieces import write_named_documents
from lintharbor.sources import report_pass as rpp
from lintharbor.sources import reports as rp


def project_name(target: Column) -> Column:
    """Last path component; `.` and `/` have none."""
    name = F.substring_index(F.rtrim(target, F.lit("/")), "/", -1)
    return F.when(name == ".", "").otherwise(name)


def format_duration(seconds: Column) -> Column:
    """`12.3 seconds`; one decimal, rounded by the binary value, without grouping or exponent."""
    return F.concat(tx.one_decimal(seconds), F.lit(" seconds"))


def iso_timestamp(ts: Column) -> Column:
    """ISO text; whole seconds carry no fraction."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def scan_summary(findings: DataFrame, runs: DataFrame, languages: DataFrame | None = None,
                 tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """One row per scan of `runs`, clean scans included: counts, counters, score and level.

    `findings` is the union before deduplication; the counters need the copies. `runs` is a run table or,
    so that reports are parsed but once, the run rows of a report pass.
    """
    counts = ru.severity_buckets(findings)
    facts = ru.run_facts(runs, languages, tools).join(counts, SCAN_KEYS, "left").fillna(
        0, [c for c in counts.columns if c not in SCAN_KEYS])
    return risk.with_risk(facts).withColumn("scan_duration", format_duration(F.col("elapsed_s")))


def summary_of_runs(runs: DataFrame) -> DataFrame:
    """`scan_summary` of a run table, whose reports are read once."""
    tagged = rpp.written(rpp.tagged_rows(runs))
    return scan_summary(rpp.findings(tagged), rpp.run_rows(tagged))


def report_summary(summary: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds what the documents need from `targets` (project, target_path, timestamp, languages).

    `targets` has one row a project, or one a scan if it has a `scan_id`. Scans it does not name
    stay, with `.` as their target.
    """
    keys = target_keys(targets)
    return join_per_project(summary, targets, keys, "left", spread_by=["scan_id"]).withColumn(
        "target_path", F.coalesce("target_path", F.lit("."))).withColumn(
        "project_name", project_name(F.col("target_path")))


def target_keys(targets: DataFrame) -> list[str]:
    return [k for k in SCAN_KEYS if k in targets.columns]


def reject_duplicates(table: DataFrame, keys: list[str], name: str) -> None:
    """A second row for a key would write its documents twice, one into the other."""
    twice = table.groupBy(*keys).count().filter("count > 1").select(*keys).first()
    if twice is not None:
        raise ValueError(f"{name} has more than one row for {tuple(twice)}")


#: Columns a policy may have beside project and formats, and what holds where it has not.
POLICY = {"minimum": "low", "fail_on": "high", "json_file": DEFAULTS["output"]["json_file"],
          "html_file": DEFAULTS["output"]["html_file"], "sarif_file": DEFAULTS["output"]["sarif_file"]}
WEIGHTS = {"w_critical": 25, "w_high": 10, "w_medium": 3, "w_low": 1}


def complete_policy(policy: DataFrame) -> DataFrame:
    """`policy` with every column `publish` uses; NULL and absent settings get their defaults."""
    def given(name: str, default) -> Column:
        value = F.lit(default)
        return (F.coalesce(F.col(name), value) if name in policy.columns else value).alias(name)

    return policy.select("project", "formats", *[given(n, d) for n, d in {**POLICY, **WEIGHTS}.items()])


def publish(runs: DataFrame, targets: DataFrame, policy: DataFrame, out: str, *,
            readers: dict | None = None, tools: Sequence[Tool] = TOOLS,
            detected: DataFrame | None = None, suppressions: DataFrame | None = None) -> None:
    """Read reports, store findings and summaries, write the documents each policy asks for.

    `policy` has (project, formats) and may have a minimum severity, the gate `fail_on`, file names and
    weights; `suppressions` (project, fingerprint) lists false positives. What a policy keeps out is
    neither listed nor counted. `detected` are findings of our own detection (`detect.as_findings`), of
    scans in `runs`. `readers` and `tools` name further scanners.

    Reports are read and parsed once, into tagged rows that everything else reads. The deduplicated
    findings and the summary are written as tables, by scan; scans of earlier batches below `out` stay.
    Each document is one file under the name its policy gives. A lost executor only costs its tasks.
    """
    spark = runs.sparkSession
    reject_duplicates(targets, target_keys(targets), "targets")
    reject_duplicates(policy, ["project"], "policy")
    policy = stored(complete_policy(policy))
    tagged = rpp.written(rpp.tagged_rows(runs, readers))
    facts = rpp.run_rows(tagged)
    union = rpp.findings(tagged)
    if detected is not None:
        union = rp.union_findings(union, with_later_seq(detected))
    if suppressions is not None:
        union = po.suppress_findings(union, suppressions).drop("fingerprint")
    union = stored(po.minimum_severity(union, policy))
    batch = stored(facts.select(*SCAN_KEYS).distinct())

    def saved(table: DataFrame, name: str) -> DataFrame:
        (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*SCAN_KEYS).parquet(f"{out}/{name}"))
        # Folder names are read as texts, whatever they look like.
        again = spark.read.schema(table.schema).parquet(f"{out}/{name}").select(*table.columns)
        return again.join(batch, SCAN_KEYS, "left_semi")

    findings = saved(ru.dedup_findings(union).drop("is_taint"), "findings")
    languages = targets.select("project", F.array_contains("languages", "TypeScript").alias("typescript"))
    counted = risk.with_build_gate(risk.with_weighted_risk(scan_summary(union, facts, languages, tools), policy), policy)
    summary = saved(report_summary(counted, targets), "summary")

    def asked(df: DataFrame, fmt: str) -> DataFrame:
        wanted = policy.filter(F.array_contains("formats", fmt)).select("project")
        spread = ["seq"] if "seq" in df.columns else ["scan_id"]
        return join_per_project(df, wanted, ["project"], "left_semi", spread_by=spread)

    def write(pieces: DataFrame, fmt: str) -> None:
        files = policy.select("project", F.col(f"{fmt}_file").alias("file"))
        names = join_per_project(asked(summary, fmt).select(*SCAN_KEYS), files, ["project"], "inner", spread_by=["scan_id"])
        write_named_documents(pieces, names, f"{out}/{fmt}")

    scalars = summary.select(
        *SCAN_KEYS, "timestamp", "target_path", "project_name", "scans_performed",
        *risk.COUNTS, "files_scanned", "secrets_found", "outdated_dependencies", "scan_duration")
    write(json_doc.json_document(asked(findings, "json"), asked(scalars, "json")), "json")
    write(html.html_report(asked(findings, "html"), asked(summary, "html")), "html")
    roots = summary.select(*SCAN_KEYS, "target_path")
    rooted = asked(findings, "sarif").join(roots, SCAN_KEYS)
    write(sarif.sarif_document(rooted, asked(summary, "sarif"), F.col("target_path"), tools=tools), "sarif")


def with_later_seq(detected: DataFrame) -> DataFrame:
    """Findings of our own detection, numbered behind all that reports list.

    Both kinds of numbers lie below 2**62 (reports: fewer than 2**30 runs a scan), so that bit is added.
    """
    return detected.withColumn("seq", F.col("seq").bitwiseOR(F.lit(1 << 62)))
