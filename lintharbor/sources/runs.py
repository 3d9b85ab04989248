"""Run-level facts: envelopes, tool status, warnings, exit codes, report totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor import schemas
from lintharbor.functions import text as tx
from lintharbor.functions.scale import dense_numbers
from lintharbor.functions.severity import strip
from lintharbor.sources import reports as rp


def load_reports(spark: SparkSession, path: str, tool: str, project: str, scan_id: str,
                 unit: str | None = None) -> DataFrame:
    """Report files below `path`, one run each, as if the tool had printed them and found issues.

    Runs are numbered from 0 by the names of the files.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.lit(project).alias("project"), F.lit(scan_id).alias("scan_id"),
        F.col("_metadata.file_path").alias("file"), "value")
    texts = dense_numbers(texts, ["project", "scan_id"], ["file"], "run_no")
    values = {
        "project": F.col("project"), "scan_id": F.col("scan_id"),
        "run_no": F.col("run_no"), "tool": F.lit(tool),
        "unit": F.lit(unit).cast("string"), "exit_code": F.lit(1), "stdout": F.col("value"),
        "stderr": F.lit(""), "duration_s": F.lit(0.0), "file_count": F.lit(0),
        "target_exists": F.lit(True), "timed_out": F.lit(False),
    }
    return texts.select(*[c.alias(n) for n, c in values.items()])


def report_error() -> Column:
    """Error text a run leaves in its report, NULL if none."""
    return F.nullif(F.get_json_object(F.col("stdout"), "$.error"), F.lit(""))


def scan_envelope(runs: DataFrame) -> DataFrame:
    """One status row per run. Bad JSON keeps the raw text and does not fail the run."""
    blank = strip(F.col("stdout")) == ""
    checked = F.when(F.col("stdout").isNull() | blank, "empty").when(tx.is_json(F.col("stdout")), "report").otherwise("raw")
    # Behind a generator the check runs once, although three columns ask for its outcome.
    runs = runs.select("*", F.inline(F.array(F.struct(checked.alias("_kind")))))
    kind = F.col("_kind")
    return runs.select(
        *rp.RUN_KEYS, "tool", "unit",
        rp.succeeded(F.col("exit_code")).alias("success"),
        "exit_code",
        kind.alias("data_kind"),
        F.when(kind == "raw", F.col("stdout")).alias("raw_output"),
        F.when(rp.succeeded(F.col("exit_code")), F.lit(None))
        .when(F.col("exit_code") == 124, "Scan timeout after 5 minutes")
        .when((F.col("exit_code") == 2) & (kind == "empty"), "Error running scanner")
        .otherwise(F.coalesce(report_error(), F.lit("Unknown error"))).alias("error"),
        tx.text_or(F.col("stderr"), "").alias("stderr"),
    )


def _stderr() -> Column:
    return F.coalesce(strip(F.col("stderr")), F.lit(""))


def _unparseable(valid: Column | None = None) -> Column:
    out = F.coalesce(F.col("stdout"), F.lit(""))
    return (out != "") & ~(tx.is_json(out) if valid is None else valid)


def tool_failure(valid: Column | None = None) -> Column:
    """Reason a tool's own reader gives up, NULL if it succeeds. `valid`: the report's check, where it was made."""
    tool, code = F.col("tool"), F.coalesce(F.col("exit_code"), F.lit(0))
    missing = ~F.coalesce(F.col("target_exists"), F.lit(True))
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    parse_error = F.concat(F.lit("Failed to parse "), tool, F.lit(" output"))
    return (
        # An audit without a manifest is a clean, empty result.
        F.when(missing & (tool != "pip-audit"), "Target path does not exist")
        .when(timed_out, F.concat(tool, F.lit(" scan timed out")))
        .when((tool == "Bandit") & (_stderr() != "") & ~code.isin(0, 1),
              F.concat(F.lit("Bandit error: "), _stderr()))
        .when((tool == "Semgrep") & code.isin(2, 3),
              F.concat(F.lit("Semgrep error (code "), code.cast("string"), F.lit("): "),
                       tx.text_or(F.col("stderr"), "")))
        .when((tool != "pip-audit") & _unparseable(valid), parse_error)
    )


def tool_status(runs: DataFrame) -> DataFrame:
    checked = runs.select(*rp.RUN_KEYS, "tool", F.inline(F.array(F.struct(tool_failure().alias("error")))))
    return checked.select(*rp.RUN_KEYS, "tool", F.col("error").isNull().alias("success"), "error")


def scan_warnings(runs: DataFrame) -> DataFrame:
    """Text on stderr of runs that succeeded all the same."""
    return (
        runs.filter(F.col("tool").isin("Bandit", "ESLint", "npm audit"))
        .filter(tool_failure().isNull() & (_stderr() != ""))
        .select(*rp.RUN_KEYS, "tool", _stderr().alias("warnings"))
    )


def report_total(tool: Column, stdout: Column, unit: Column) -> Column:
    """Issue count of one report: listed findings, except the Node audit, which states a total."""
    def listed(items: rp.Items) -> Column:
        return F.greatest(F.coalesce(F.size(items(stdout, unit)), F.lit(0)), F.lit(0))

    stated = F.coalesce(
        F.from_json(stdout, schemas.NPM_METADATA)["metadata"]["vulnerabilities"]["total"], F.lit(0))
    chain = F.when(tool == "npm audit", stated)
    counted = {name: items for name, (items, _) in rp.READERS.items() if name != "npm audit"}
    # Counting needs no field of the flattened findings, so only one is built.
    counted["Semgrep"] = lambda out, u: rp.semgrep_items(out, u, ("line",))
    for name, items in counted.items():
        chain = chain.when(tool == name, listed(items))
    return chain.otherwise(0)


def exit_status(runs: DataFrame) -> DataFrame:
    """Exit code per run: 2 failed, 1 issues found, 0 clean."""
    total = report_total(F.col("tool"), F.col("stdout"), F.col("unit"))
    facts = F.struct(tool_failure().isNotNull().alias("failed"), total.alias("total_issues"))
    return with_exit_status(runs.select(*rp.RUN_KEYS, "tool", F.inline(F.array(facts))))


def with_exit_status(facts: DataFrame) -> DataFrame:
    """From rows of (…, failed, total_issues)."""
    return facts.select(
        *rp.RUN_KEYS, "tool", "total_issues",
        F.when(F.col("failed"), 2).when(F.col("total_issues") > 0, 1).otherwise(0)
        .alias("exit_status"),
    )


def error_groups(runs: DataFrame) -> DataFrame:
    """Failed runs split into tools that were not installed (skipped) and real failures."""
    text = F.coalesce(report_error(), F.nullif(_stderr(), F.lit("")), F.lit("Unknown error"))
    return (
        runs.filter(~rp.succeeded(F.col("exit_code")))
        .select(*rp.RUN_KEYS, "tool", text.alias("error"))
        .withColumn("outcome", F.when(F.col("error").contains("not installed"), "skipped")
                    .otherwise("failed"))
    )


def npm_breakdown(runs: DataFrame) -> DataFrame:
    """Counts as the Node audit states them in its metadata, not as its rows add up."""
    meta = F.from_json("stdout", schemas.NPM_METADATA)["metadata"]
    counts = meta["vulnerabilities"]
    return (
        runs.filter(F.col("tool") == "npm audit")
        .filter(tx.is_json(F.col("stdout")) | (F.col("stdout") == ""))
        .select(*rp.RUN_KEYS,
                *[F.coalesce(counts[n], F.lit(0)).alias(n)
                  for n in ("critical", "high", "moderate", "low")],
                F.coalesce(counts["total"], F.lit(0)).alias("total_issues"),
                tx.text_or(meta["dependencies"], "0").alias("dependencies"))
    )


def n_errors(stdout: Column) -> Column:
    """All errors a data-flow report has; `error_sample` lists the first ten."""
    errors = F.from_json(stdout, schemas.SEMGREP_ERRORS)["errors"]
    return F.greatest(F.coalesce(F.size(errors), F.lit(0)), F.lit(0))


def error_sample(runs: DataFrame, limit: int = 10, width: int = 1000) -> DataFrame:
    """First errors a data-flow report lists; of an unreadable report the first characters."""
    report = (
        runs.filter(F.col("tool") == "Semgrep")
        .select(*rp.RUN_KEYS, F.posexplode(
            F.slice(F.from_json("stdout", schemas.SEMGREP_ERRORS)["errors"], 1, limit))
            .alias("pos", "e"))
        .select(*rp.RUN_KEYS, "pos",
                F.coalesce(F.col("e.message"), F.to_json("e")).alias("message"),
                tx.text_or(F.col("e.path"), "").alias("path"))
    )
    unread = (
        runs.filter((F.col("tool") == "Semgrep") & _unparseable())
        .select(*rp.RUN_KEYS, F.lit(-1).alias("pos"),
                F.substring("stdout", 1, width).alias("message"), F.lit("").alias("path"))
    )
    return report.unionByName(unread)
