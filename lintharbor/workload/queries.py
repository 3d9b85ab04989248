"""One query per operator, over inputs derived from the shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.functions import text as tx
from lintharbor.functions.scale import shared_dir, stored
from lintharbor.operators import detect as dt
from lintharbor.operators import listing as ls
from lintharbor.operators import path_sets as ps
from lintharbor.operators import policy as po
from lintharbor.operators import rescan
from lintharbor.operators import risk as rk
from lintharbor.operators import rollup as ru
from lintharbor.plans import end_to_end as ee
from lintharbor.rules import CODE_RULES
from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks import html, json_doc, sarif
from lintharbor.sources import files as fl
from lintharbor.sources import report_pass as rpp
from lintharbor.sources import reports as rp
from lintharbor.sources import runs as rn
from lintharbor.sources import saved as sv
from lintharbor.workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DOC_CHUNK_BITS = 8
RUN = rp.RUN_KEYS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return fx.findings(spark, sf, fx.HOUR)


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    """Unique findings as the stored table that documents and numberings read several times."""
    return stored(ru.dedup_findings(fx.findings(spark, sf)))


def root_of_project() -> Column:
    return F.concat(F.lit("/srv/"), F.col("project"))


# --- sources -------------------------------------------------------------------------------

@query
def file_inventory(spark, sf):
    return fl.inventory(fx.files(spark, sf)).filter("language is not null").select(
        "project", "path", "rel_path", "language", "excluded_dir")


@query
def read_bandit(spark, sf):
    return rp.read_bandit(fx.scan_runs(spark, sf))


@query
def read_pip_audit(spark, sf):
    return (rp.read_pip_audit(fx.scan_runs(spark, sf))
            .withColumn("fix_versions", joined("fix_versions"))
            .withColumn("aliases", joined("aliases")))


@query
def read_npm_audit(spark, sf):
    return rp.read_npm_audit(fx.scan_runs(spark, sf))


@query
def read_eslint(spark, sf):
    return rp.read_eslint(fx.scan_runs(spark, sf))


@query
def read_semgrep(spark, sf):
    return rp.read_semgrep(fx.scan_runs(spark, sf)).select(
        *RUN, "pos", "rule_id", "file", "line", "column", "end_line", "end_column", "code",
        "confidence", "category", joined("technology"))


@query
def read_secrets(spark, sf):
    return rp.read_secrets(fx.scan_runs(spark, sf))


@query
def scan_envelope(spark, sf):
    return rn.scan_envelope(fx.scan_runs(spark, sf))


@query
def read_results_doc(spark, sf):
    return sv.read_results_doc(fx.saved_documents(spark, sf)).select(
        "doc_id", "target_path", "pos", "tool", "title")


@query
def dependency_manifests(spark, sf):
    return fl.dependency_manifests(fl.inventory(fx.files(spark, sf))).withColumn(
        "manifests", joined("manifests"))


@query
def npm_project_dirs(spark, sf):
    return fl.npm_project_dirs(fl.included(fl.inventory(fx.files(spark, sf))))


# --- sinks ---------------------------------------------------------------------------------

@query
def sink_json(spark, sf):
    findings = fx.findings(spark, sf)
    summary = rk.with_risk(ru.severity_buckets(findings)).select(
        *SCAN_KEYS, F.col("project").alias("project_name"), *rk.COUNTS, "secrets_found",
        "outdated_dependencies", "raw_risk_score")
    return json_doc.json_document(deduped(spark, sf), summary, chunk_bits=DOC_CHUNK_BITS)


@query
def sarif_results(spark, sf):
    return sarif.sarif_results(fx.findings(spark, sf), root_of_project()).drop("run_rank")


@query
def sarif_document(spark, sf):
    findings = deduped(spark, sf)
    return sarif.sarif_document(findings, findings, root_of_project(), chunk_bits=DOC_CHUNK_BITS)


@query
def html_sections(spark, sf):
    return html.html_sections(deduped(spark, sf), chunk_bits=DOC_CHUNK_BITS)


def _page_summary(spark, sf):
    runs = fx.scan_runs(spark, sf)
    counts = ru.severity_buckets(fx.findings(spark, sf))
    # Scans without findings have a page too.
    return (
        ru.run_facts(runs).join(counts, SCAN_KEYS, "left").fillna(0, [c for c in counts.columns if c not in SCAN_KEYS])
        .withColumn("scan_duration", ee.format_duration(F.col("duration_s")))
        .withColumn("target_path", root_of_project())
        .withColumn("project_name", ee.project_name(F.col("target_path")))
        .withColumn("timestamp", F.lit("2024-01-31 00:00:00"))
        .withColumn("languages", F.array(F.lit("Python"), F.lit("TypeScript"))))


@query
def html_report(spark, sf):
    return html.html_report(deduped(spark, sf), _page_summary(spark, sf), chunk_bits=DOC_CHUNK_BITS)


@query
def scan_summary(spark, sf):
    return ee.summary_of_runs(fx.timed_runs(spark, sf)).withColumn(
        "scans_performed", joined("scans_performed")).drop("duration_s", "elapsed_s")


@query
def format_selection(spark, sf):
    return po.selected_formats(
        po.effective_policy(fx.client_projects(spark, sf), fx.client_policies(spark, sf)))


# --- projections ---------------------------------------------------------------------------

@query
def normalize_severity(spark, sf):
    return fx.raw_findings(spark, sf).select(
        "seq", sev.normalize_severity(F.col("severity_raw")).alias("severity"))


@query
def normalize_findings(spark, sf):
    return rp.tool_findings(fx.scan_runs(spark, sf), "Bandit").drop(
        "cwe", "owasp", "references", "is_taint")


@query
def project_pip_audit(spark, sf):
    return rp.tool_findings(fx.scan_runs(spark, sf), "pip-audit").drop(
        "cwe", "owasp", "references", "is_taint", "column")


@query
def project_npm(spark, sf):
    return rp.tool_findings(fx.scan_runs(spark, sf), "npm audit").drop(
        "cwe", "owasp", "references", "is_taint", "column", "rule_id")


@query
def redact_secrets(spark, sf):
    return rp.tool_findings(fx.scan_runs(spark, sf), "Secret Scanner").drop(
        "cwe", "owasp", "references", "is_taint", "column", "rule_id")


@query
def project_semgrep(spark, sf):
    return rp.read_semgrep(fx.scan_runs(spark, sf)).select(
        *RUN, "pos", "rule_id", "title", "severity", "message", "description", "file", "line", "fix",
        joined("references"), joined("cwe"), joined("owasp"), "is_taint_finding",
        F.col("taint_source.file").alias("source_file"), F.col("taint_source.line").alias("source_line"),
        F.col("taint_source.content").alias("source_content"),
        F.col("taint_sink.file").alias("sink_file"), F.col("taint_sink.line").alias("sink_line"),
        F.col("taint_sink.content").alias("sink_content"))


@query
def semgrep_severity(spark, sf):
    return fx.raw_findings(spark, sf).select(
        "seq", sev.semgrep_severity(sev.strip(F.col("severity_raw"))).alias("severity"))


@query
def eslint_severity(spark, sf):
    level = F.expr("cast(case when seq % 5 = 4 then null else seq % 5 end as int)")
    return fx.raw_findings(spark, sf).select("seq", sev.eslint_severity(level).alias("severity"))


@query
def pip_audit_severity(spark, sf):
    return rp.read_pip_audit(fx.scan_runs(spark, sf)).select(
        *RUN, "pos", "vulnerability_id", "severity")


@query
def taxonomy_enrich(spark, sf):
    return rp.read_semgrep(fx.scan_runs(spark, sf)).select(
        *RUN, "pos", tx.with_taxonomy(F.col("description"), F.col("cwe"), F.col("owasp"))
        .alias("description"))


@query
def taint_annotate(spark, sf):
    return rp.read_semgrep(fx.scan_runs(spark, sf)).select(
        *RUN, "pos", "is_taint_finding",
        tx.with_taint(F.col("description"), F.col("is_taint_finding"), F.col("taint_source"),
                      F.col("taint_sink")).alias("description"))


@query
def finding_fingerprint(spark, sf):
    return ru.with_fingerprint(fx.findings(spark, sf)).select("seq", "fingerprint")


@query
def sarif_level(spark, sf):
    return fx.findings(spark, sf).select("seq", sev.sarif_level(F.expr(
        "case when seq % 9 = 0 then null else severity end")).alias("level"))


@query
def sarif_score(spark, sf):
    return fx.findings(spark, sf).select("seq", sev.sarif_score(F.expr(
        "case when seq % 9 = 0 then 'info' when seq % 9 = 1 then null else severity end"))
        .alias("score"))


@query
def relative_uri(spark, sf):
    file = F.expr("case when seq % 11 = 0 then '' when seq % 11 = 1 then null "
                  "when seq % 11 = 2 then 'unknown' else file end")
    return fx.findings(spark, sf).select("seq", tx.relative_uri(
        file, F.concat(F.lit("/srv/proj"), (F.col("seq") % 10).cast("string"))).alias("uri"))


@query
def region_clamp(spark, sf):
    return fx.findings(spark, sf).select(
        "seq", sarif.at_least_one(F.col("line") - F.lit(2)).alias("start_line"),
        sarif.at_least_one(F.col("column")).alias("start_column"))


@query
def snippet_filter(spark, sf):
    return fx.findings(spark, sf).select("seq", sarif.snippet(F.col("code")).alias("snippet"))


@query
def risk_level(spark, sf):
    return rk.with_risk(ru.severity_buckets(hourly(spark, sf))).select(
        *SCAN_KEYS, "risk_score", "risk_level")


@query
def risk_text(spark, sf):
    scored = rk.with_risk(ru.severity_buckets(hourly(spark, sf)))
    return scored.select(*SCAN_KEYS, rk.risk_description(F.col("linear_score")).alias("description"),
                         rk.risk_class(F.col("linear_score")).alias("css_class"))


@query
def html_escape(spark, sf):
    return fx.findings(spark, sf).select(
        "seq", tx.html_escape(F.col("description")).alias("description"))


@query
def executive_summary(spark, sf):
    return ru.severity_buckets(hourly(spark, sf)).select(
        *SCAN_KEYS, html.executive_summary(F.col("project"), F.col("total"), F.col("critical_count"))
        .alias("summary"))


@query
def recommendations(spark, sf):
    b = ru.severity_buckets(hourly(spark, sf)).withColumn("advice", html.recommendations(
        F.col("critical_count"), F.col("high_count"), F.col("secrets_found"),
        F.col("outdated_dependencies"), F.col("medium_count")))
    return b.select(*SCAN_KEYS, F.posexplode("advice").alias("pos", "advice"))


@query
def scan_label(spark, sf):
    langs = fl.project_languages(fl.included(fl.inventory(fx.files(spark, sf))))
    return langs.select("project", ru.scan_label(F.col("typescript")).alias("scan_name"))


@query
def format_duration(spark, sf):
    return fx.scan_runs(spark, sf).select(
        *RUN, ee.format_duration(F.col("duration_s")).alias("scan_duration"))


@query
def tool_status(spark, sf):
    return rn.tool_status(fx.scan_runs(spark, sf))


@query
def scan_warnings(spark, sf):
    return rn.scan_warnings(fx.scan_runs(spark, sf))


@query
def project_name(spark, sf):
    slash = F.expr("case when event_id % 2 = 0 then '/' else '' end")
    return fx.events(spark, sf).select(
        "event_id",
        ee.project_name(F.concat(F.lit("/srv/"), F.expr(fx.PROJECT), slash)).alias("project_name"),
        ee.iso_timestamp(F.col("ts")).alias("timestamp"))


# --- filters -------------------------------------------------------------------------------

@query
def exclude_dirs(spark, sf):
    return fl.inventory(fx.files(spark, sf)).filter(~F.col("excluded_dir")).select("project", "path")


@query
def exclude_globs(spark, sf):
    return fl.exclude_globs(fl.inventory(fx.files(spark, sf)), fx.exclude_globs(spark, sf)).select(
        "project", "path")


@query
def security_rule_filter(spark, sf):
    messages = rp.read_eslint(fx.scan_runs(spark, sf))
    return messages.filter(rp.is_security_rule(F.col("rule_id")))


@query
def scan_plan(spark, sf):
    included = fl.included(fl.inventory(fx.files(spark, sf)))
    return po.scan_plan(fx.app_policies(spark, sf), fl.project_languages(included),
                        fl.npm_project_dirs(included))


@query
def successful_scans(spark, sf):
    return rp.findings_from_runs(fx.scan_runs(spark, sf)).select(
        *SCAN_KEYS, "seq", "tool", "severity", "title")


@query
def vulnerable_dependencies(spark, sf):
    return rp.read_pip_dependencies(fx.scan_runs(spark, sf)).filter("n_vulns > 0")


@query
def not_installed_errors(spark, sf):
    return rn.error_groups(fx.scan_runs(spark, sf))


@query
def tool_partition(spark, sf):
    other = F.when(F.col("seq") % 13 == 0, "Custom").otherwise(F.col("tool"))
    return sarif.tool_partition(fx.findings(spark, sf).withColumn("tool", other)).select(
        "seq", "run_rank", "run_name")


@query
def node_modules_ts(spark, sf):
    return fl.typescript_outside_node_modules(fl.inventory(fx.files(spark, sf)))


@query
def eslint_ignore(spark, sf):
    return fl.eslint_files(fl.inventory(fx.files(spark, sf))).select("project", "path", "language")


@query
def minimum_severity(spark, sf):
    return po.minimum_severity(fx.findings(spark, sf), fx.settings(spark, sf)).select(
        "project", "seq", "severity")


@query
def include_patterns(spark, sf):
    return fl.include_patterns(fl.inventory(fx.files(spark, sf)), fx.include_globs(spark, sf)).select(
        "project", "path")


@query
def suppress_findings(spark, sf):
    kept = po.suppress_findings(ru.dedup_findings(fx.findings(spark, sf)), fx.suppressions(spark, sf))
    return kept.select(*SCAN_KEYS, "seq", "fingerprint")


# --- joins ---------------------------------------------------------------------------------

@query
def effective_policy(spark, sf):
    p = po.effective_policy(fx.client_projects(spark, sf), fx.client_policies(spark, sf))
    return p.select("project", *po.SCANNERS, joined("exclude"), joined("include"), joined("formats"),
                    "json_file", "html_file", "sarif_file", "verbose", "minimum", "fail_on")


@query
def owasp_rollup(spark, sf):
    return dt.owasp_rollup(fx.findings(spark, sf))


@query
def remediation_lookup(spark, sf):
    hits = dt.vulnerable_pattern_scan(fx.sources(spark, sf))
    return dt.remediation_lookup(hits).select(
        "path", "line", "rule_id", "family", "owasp_category", "secure_pattern")


# --- aggregations --------------------------------------------------------------------------

@query
def dedup_findings(spark, sf):
    return ru.dedup_findings(fx.findings(spark, sf)).drop("cwe", "references").withColumn(
        "owasp", joined("owasp"))


@query
def severity_buckets(spark, sf):
    return ru.severity_buckets(hourly(spark, sf)).select(*SCAN_KEYS, *rk.COUNTS, "total")


@query
def bandit_breakdown(spark, sf):
    return ru.bandit_breakdown(rp.read_bandit(fx.scan_runs(spark, sf)))


@query
def semgrep_breakdown(spark, sf):
    return ru.semgrep_breakdown(rp.read_semgrep_fields(fx.scan_runs(spark, sf), "severity"))


@query
def npm_breakdown(spark, sf):
    return rn.npm_breakdown(fx.scan_runs(spark, sf))


def flow_pass(spark, sf):
    return rpp.written(rpp.tagged_rows(fx.scan_runs(spark, sf).filter("tool = 'Semgrep'")))


@query
def semgrep_multi_config(spark, sf):
    return ru.semgrep_multi_config(flow_pass(spark, sf))


@query
def semgrep_merged_findings(spark, sf):
    merged, _, _ = rpp.merged_flow(flow_pass(spark, sf))
    return merged.select(*SCAN_KEYS, "seq", "severity", "title", "file", "line", "rule_id")


@query
def files_scanned(spark, sf):
    return ru.files_scanned(fx.scan_runs(spark, sf))


@query
def secret_and_dependency_counts(spark, sf):
    return ru.secret_and_dependency_counts(hourly(spark, sf))


@query
def scans_performed(spark, sf):
    return ru.scans_performed(fx.scan_runs(spark, sf)).withColumn(
        "scans_performed", joined("scans_performed"))


@query
def risk_score(spark, sf):
    return rk.with_risk(ru.severity_buckets(hourly(spark, sf))).select(
        *SCAN_KEYS, *rk.COUNTS, "raw_risk_score", "risk_score", "risk_level")


@query
def risk_score_linear(spark, sf):
    return rk.with_risk(ru.severity_buckets(hourly(spark, sf))).select(*SCAN_KEYS, "linear_score")


@query
def risk_weighted(spark, sf):
    return rk.with_weighted_risk(ru.severity_buckets(hourly(spark, sf)), fx.settings(spark, sf)).select(
        *SCAN_KEYS, "weighted_score")


@query
def build_gate(spark, sf):
    return rk.with_build_gate(ru.severity_buckets(hourly(spark, sf)), fx.settings(spark, sf)).select(
        *SCAN_KEYS, "fail_on", "build_fails")


@query
def severity_distribution(spark, sf):
    return rk.severity_distribution(ru.severity_buckets(fx.findings(spark, sf)))


@query
def sarif_rules(spark, sf):
    return sarif.sarif_rules(fx.findings(spark, sf)).drop("run_rank")


@query
def taint_count(spark, sf):
    return ru.taint_count(rp.read_semgrep_fields(fx.scan_runs(spark, sf), "is_taint_finding"))


@query
def project_languages(spark, sf):
    return fl.project_languages(fl.included(fl.inventory(fx.files(spark, sf))))


@query
def total_issues(spark, sf):
    return ru.total_issues(hourly(spark, sf))


@query
def exit_status(spark, sf):
    return rn.exit_status(fx.scan_runs(spark, sf))


# --- window, sort, limit -------------------------------------------------------------------

@query
def top_n_per_severity(spark, sf):
    return ls.top_n_per_severity(fx.findings(spark, sf)).select(
        *SCAN_KEYS, "severity", "rank", "seq", "more")


@query
def top_n_packages(spark, sf):
    packages = rp.read_npm_audit(fx.scan_runs(spark, sf)).withColumn(
        "seq", F.col("run_no") * F.lit(2**32) + F.col("pos"))
    return ls.top_n(packages, SCAN_KEYS, 20).select(
        *SCAN_KEYS, "rank", "seq", "package", F.upper("severity").alias("severity"), "more")


@query
def numbered_findings(spark, sf):
    return ls.numbered(fx.findings(spark, sf)).select(*SCAN_KEYS, "tool", "seq", "number")


@query
def error_sample(spark, sf):
    return rn.error_sample(fx.scan_runs(spark, sf))


@query
def message_preview(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", ls.preview(F.col("text")).alias("preview"))


@query
def severity_order(spark, sf):
    return ls.severity_order(fx.findings(spark, sf)).select(*SCAN_KEYS, "severity_rank", "seq")


@query
def remediation_priority(spark, sf):
    return ls.remediation_priority(deduped(spark, sf)).select(*SCAN_KEYS, "seq", "priority", "vuln_id")


@query
def primary_concerns(spark, sf):
    return ls.primary_concerns(fx.findings(spark, sf))


# --- set operations ------------------------------------------------------------------------

@query
def union_findings(spark, sf):
    # All tools of a run table in one pass over it.
    return rp.findings_from_runs(fx.scan_runs(spark, sf), any_outcome=True).select(
        *SCAN_KEYS, "seq", "tool", "severity", "title", "file", "line", "rule_id")


@query
def union_manifests(spark, sf):
    return rp.read_pip_audit(fx.scan_runs(spark, sf)).select(
        *SCAN_KEYS, F.substring_index("source_file", "/", -1).alias("manifest"), "package",
        "vulnerability_id")


@query
def distinct_paths(spark, sf):
    return fl.distinct_paths(rp.scanned_paths(fx.scan_runs(spark, sf)))


@query
def merged_file_counts(spark, sf):
    """Distinct files per run, scan and project, as unions of bitmaps."""
    return ps.file_counts(rp.scanned_paths(fx.scan_runs(spark, sf)))


# --- extensions ----------------------------------------------------------------------------

@query
def custom_reader(spark, sf):
    """A scanner with its own report shape joins the common pass: rows are `path:line:rule` lines."""
    def items(stdout: Column, unit: Column) -> Column:
        rows = F.filter(F.split(stdout, "\n"), lambda r: r != "")
        return F.transform(rows, lambda r: F.create_map(
            F.lit("file"), F.split_part(r, F.lit(":"), F.lit(1)),
            F.lit("line"), F.split_part(r, F.lit(":"), F.lit(2)),
            F.lit("rule_id"), F.split_part(r, F.lit(":"), F.lit(3)),
            F.lit("severity"), F.lit("warning")))

    runs = fx.events(spark, sf).selectExpr(
        f"{fx.PROJECT} as project", f"{fx.HALF} as scan_id", "event_id as run_no", "'Lint' as tool",
        "cast(null as string) as unit", "cast(event_id % 3 as int) as exit_code",
        "concat('a.go:', cast(user_id as string), ':G1\n', 'b.go:2:', event_type, '\n') as stdout")
    readers = rp.register_reader("Lint", items)
    return rp.findings_from_runs(runs, readers).select(
        *SCAN_KEYS, "seq", "tool", "severity", "title", "file", "line", "column", "rule_id")


OVERRIDE_LEVELS = {"CRY01": "off", "RND02": "error", "SQL03": "warn"}


@query
def custom_rules(spark, sf):
    apps = fx.app_policies(spark, sf)
    overrides = apps.filter("python").select("project", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule_id"), F.lit(v).alias("level"))
        for r, v in OVERRIDE_LEVELS.items()])))
    return dt.custom_rules(dt.vulnerable_pattern_scan(fx.sources(spark, sf)), overrides).select(
        "path", "line", "rule_id", "severity")


# --- detection -----------------------------------------------------------------------------

@query
def explode_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return dt.explode_lines(docs)


@query
def secret_detection(spark, sf):
    return dt.secret_detection(fx.corpus(spark, sf))


@query
def vulnerable_pattern_scan(spark, sf):
    return dt.vulnerable_pattern_scan(fx.sources(spark, sf)).select(
        "project", "path", "language", "line", "rule_id", "title", "owasp", "family", "severity")


@query
def rule_rescan(spark, sf):
    """All code rules over the files that a trigram index lets through."""
    texts = stored(fx.sources(spark, sf))
    index = f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}"
    rescan.build_index(texts, index)
    return rescan.rescan(texts, index, CODE_RULES, dt.vulnerable_pattern_scan).select(
        "project", "path", "language", "line", "rule_id", "title", "owasp", "family", "severity")


@query
def missing_control_scan(spark, sf):
    return dt.missing_control_scan(fx.control_sources(spark, sf)).select(
        "project", "path", "rule_id", "title", "owasp")


@query
def secret_type_rollup(spark, sf):
    return ru.secret_type_rollup(dt.secret_detection(fx.corpus(spark, sf)))
