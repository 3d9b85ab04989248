"""Effective policy per project, scan plan, thresholds and suppressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.functions.scale import join_per_project
from lintharbor.functions.text import as_list, is_truthy_json
from lintharbor.operators import rollup as ru

# Default policy, leaves as JSON text.
DEFAULTS: dict[str, dict[str, str]] = {
    "scan": {
        "python": "true", "javascript": "true", "secrets": "true", "dependencies": "true",
        "semgrep": "true",
    },
    "output": {
        "formats": '["text","json","html","sarif"]', "json_file": "security-results.json",
        "html_file": "security-report.html", "sarif_file": "security-results.sarif",
        "verbose": "false",
    },
    "severity": {"minimum": "low", "fail_on": "high"},
}
SCANNERS = list(DEFAULTS["scan"])
TEXT_MAP = "map<string,string>"


def parse_formats(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda f: F.lower(sev.strip(f)))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def merge_maps(base: Column, override: Column) -> Column:
    """Override wins key by key, explicit nulls included; lists are replaced whole."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def effective_policy(projects: DataFrame, policies: DataFrame) -> DataFrame:
    """Defaults < project policy (project, policy_json) < switches (skip array, cli_formats).

    `projects` carries (project, skip, cli_formats). Sections merge as maps, so keys unknown to
    the defaults survive and an explicit null differs from an absent key.
    """
    joined = projects.join(policies, "project", "left")
    user = F.from_json("policy_json", TEXT_MAP)
    for name, values in DEFAULTS.items():
        section = F.coalesce(F.from_json(user.getItem(name), TEXT_MAP),
                             F.create_map().cast(TEXT_MAP))
        joined = joined.withColumn(f"_{name}", merge_maps(_literal_map(values), section))

    def leaf(section: str, key: str) -> Column:
        return F.col(f"_{section}").getItem(key)

    def enabled(name: str) -> Column:
        skipped = F.coalesce(F.array_contains("skip", name), F.lit(False))
        return ~skipped & is_truthy_json(leaf("scan", name))

    formats = F.when(F.col("cli_formats").isNotNull(), parse_formats(F.col("cli_formats"))).otherwise(
        as_list(leaf("output", "formats")))
    return joined.select(
        "project",
        *[enabled(n).alias(n) for n in SCANNERS],
        as_list(leaf("scan", "exclude")).alias("exclude"),
        as_list(leaf("scan", "include")).alias("include"),
        formats.alias("formats"),
        *[leaf("output", k).alias(k) for k in ("json_file", "html_file", "sarif_file")],
        is_truthy_json(leaf("output", "verbose")).alias("verbose"),
        leaf("severity", "minimum").alias("minimum"),
        leaf("severity", "fail_on").alias("fail_on"),
    )


def risk_weights(policies: DataFrame) -> DataFrame:
    """(project, w_critical, w_high, w_medium, w_low) from the `risk.weights` of policy texts (project, policy_json).

    A weight that is absent, null or no number is NULL; scoring then takes its default.
    """
    weights = F.from_json(F.get_json_object("policy_json", "$.risk.weights"), TEXT_MAP)
    return policies.select("project", *[
        weights.getItem(b).try_cast("int").alias(f"w_{b}") for b in sev.BUCKETS])


def selected_formats(policy: DataFrame) -> DataFrame:
    """Which sinks run per project; unknown words select nothing."""
    return policy.select("project", *[
        F.array_contains("formats", f).alias(f"write_{f}") for f in ("text", "json", "html", "sarif")])


def scan_plan(policy: DataFrame, languages: DataFrame, npm_dirs: DataFrame) -> DataFrame:
    """Scans that apply per project, one row each; the Node audit has one per package.json."""
    code = languages.select("project", F.col("python").alias("python_code"),
                            F.col("javascript").alias("javascript_code"), "typescript")
    p = policy.join(code, "project", "left").fillna(
        False, ["python_code", "javascript_code", "typescript"])

    def step(cond: Column, tool: str) -> Column:
        return F.when(cond, F.struct(
            F.lit(tool).alias("tool"),
            ru.scan_name(F.lit(tool), F.col("typescript")).alias("scan_name")))

    whole = p.select("project", F.inline(F.array_compact(F.array(
        step(F.col("python_code") & F.col("python"), "Bandit"),
        step(F.col("python_code") & F.col("dependencies"), "pip-audit"),
        step(F.col("javascript_code") & F.col("javascript"), "ESLint"),
        step(F.col("secrets"), "Secret Scanner"),
        step(F.col("semgrep"), "Semgrep"),
    )))).withColumn("unit", F.lit(None).cast("string"))
    per_dir = (
        join_per_project(npm_dirs, policy.filter("dependencies").select("project"), ["project"],
                         "left_semi", spread_by=["project_dir"])
        .select("project", F.lit("npm audit").alias("tool"),
                ru.scan_name(F.lit("npm audit"), F.lit(False)).alias("scan_name"),
                F.col("project_dir").alias("unit")))
    return whole.unionByName(per_dir)


def minimum_severity(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings at or above the project's threshold; `low`, the default, keeps everything."""
    floor = policy.select("project", sev.bucket_rank(F.lower("minimum")).alias("_floor"))
    rank = sev.bucket_rank(sev.severity_bucket(F.col("severity")))
    return (
        join_per_project(findings, floor, ["project"], "left", spread_by=["seq"])
        .filter(rank <= F.coalesce("_floor", F.lit(3))).drop("_floor"))


def suppress_findings(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drops findings whose fingerprint a project lists as a false positive.

    Both sides can be large, so neither is copied; AQE splits a fingerprint that recurs in very
    many scans of a project.
    """
    return ru.with_fingerprint(findings).join(
        suppressions.select("project", "fingerprint"), ["project", "fingerprint"], "left_anti")
