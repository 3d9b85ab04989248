"""Ordered views of findings: top-n per group, numbering, previews, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.functions.scale import first_per_key, number_rows
from lintharbor.schemas import SCAN_KEYS


def preview(text: Column, width: int = 100) -> Column:
    return F.concat(F.substring(text, 1, width), F.lit("..."))


def top_n(findings: DataFrame, keys: list[str], n: int, order: str = "seq") -> DataFrame:
    """First `n` rows per group with their rank and the number of rows left out.

    Rows are pruned before the shuffle and the group sizes come from a separate count, so a large
    group is never gathered.
    """
    shown = first_per_key(findings, keys, order, n, rank="rank")
    sizes = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return shown.join(sizes, keys).withColumn(
        "more", F.greatest(F.col("_size") - n, F.lit(0).cast("bigint"))).drop("_size")


def top_n_per_severity(findings: DataFrame, n: int = 10) -> DataFrame:
    known = findings.filter(F.col("severity").isin(*sev.BUCKETS))
    return top_n(known, [*SCAN_KEYS, "severity"], n)


def numbered(findings: DataFrame, digit_bits: int = 20) -> DataFrame:
    """Adds `number`: 1-based position inside each tool's listing."""
    return number_rows(findings, [*SCAN_KEYS, "tool"], out="number", digit_bits=digit_bits)


def with_severity_order(findings: DataFrame) -> DataFrame:
    rank = sev.bucket_rank(sev.severity_bucket(F.col("severity")))
    return findings.withColumn("severity_rank", rank)


def severity_order(findings: DataFrame) -> DataFrame:
    """Presentation order. The sort key ends in seq, so range partitions split any project."""
    return with_severity_order(findings).orderBy(*SCAN_KEYS, "severity_rank", "seq")


# Words that tell which documented fix group a finding belongs to.
AUTH_WORDS = r"(?i)(auth|login|session|password|access|permission|privilege|idor)"
INJECTION_WORDS = r"(?i)(inject|xss|cross-site|command|traversal|deserial|eval)"
CRYPTO_WORDS = r"(?i)(crypt|md5|sha1|random|hardcoded|secret)"


def fix_priority() -> Column:
    """Documented fix order, 1 (first) to 6."""
    text = F.concat_ws(" ", "title", "rule_id")
    bucket = sev.severity_bucket(F.col("severity"))
    patched = F.col("tool").isin("pip-audit", "npm audit") & ~F.coalesce(
        F.col("fix") == "No fix available", F.lit(True))
    return (
        F.when(bucket == "critical", 1)
        .when((bucket == "high") & text.rlike(AUTH_WORDS), 2)
        .when(text.rlike(INJECTION_WORDS), 3)
        .when(text.rlike(CRYPTO_WORDS), 4)
        .when(patched, 5)
        .otherwise(6))


def remediation_priority(findings: DataFrame, digit_bits: int = 20) -> DataFrame:
    """Findings in fix order with ids VULN-001, VULN-002, ... per scan."""
    ranked = number_rows(
        findings.withColumn("priority", fix_priority()), SCAN_KEYS, lead=["priority"], out="_n",
        digit_bits=digit_bits)
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return ranked.withColumn("vuln_id", F.concat(F.lit("VULN-"), padded)).drop("_n")


def primary_concerns(findings: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent issue types per project; ties go by title."""
    counts = findings.groupBy("project", "title").agg(F.count(F.lit(1)).alias("n_findings"))
    w = Window.partitionBy("project").orderBy(F.desc("n_findings"), "title")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
