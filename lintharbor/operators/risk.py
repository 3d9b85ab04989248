"""Risk scores, levels, gates and severity shares from four counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import text as tx
from lintharbor.functions.scale import join_per_project

COUNTS = ["critical_count", "high_count", "medium_count", "low_count"]


def _log_part(count: Column, weight: int, cap: int) -> Column:
    return F.least(F.lit(float(cap)), weight * F.log2(count + 1))


def raw_risk_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """Logarithmic score before the cap; log2(0 + 1) makes empty buckets add nothing."""
    return F.floor(
        F.when(critical > 0, 50 + _log_part(critical, 10, 30)).otherwise(0.0)
        + _log_part(high, 15, 40) + _log_part(medium, 7, 20) + _log_part(low, 3, 10))


def linear_score(critical: Column, high: Column, medium: Column, low: Column,
                 weights: tuple[Column | int, ...] = (25, 10, 3, 1)) -> Column:
    c, h, m, lo = weights
    return F.least(critical * c + high * h + medium * m + low * lo, F.lit(100).cast("bigint"))


def _by_cutoff(score: Column, texts: tuple[str, str, str, str]) -> Column:
    return (F.when(score >= 75, texts[0]).when(score >= 50, texts[1]).when(score >= 25, texts[2])
            .otherwise(texts[3]))


def risk_level(score: Column) -> Column:
    return _by_cutoff(score, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


def risk_description(score: Column) -> Column:
    # Report texts.
    return _by_cutoff(score, (
        "🔴 Critical - Immediate remediation required",
        "🟠 High - Address vulnerabilities within 24-48 hours",
        "🟡 Medium - Plan remediation within 1-2 weeks",
        "🟢 Low - Minor issues, address during regular maintenance",
    ))


def risk_class(score: Column) -> Column:
    return _by_cutoff(score, ("risk-high", "risk-medium", "risk-low", "risk-low"))


def with_risk(buckets: DataFrame) -> DataFrame:
    """Adds the logarithmic score (raw and capped), its level, and the linear report score."""
    cols = [F.col(c) for c in COUNTS]
    return (
        buckets.withColumn("raw_risk_score", raw_risk_score(*cols))
        .withColumn("risk_score", F.least("raw_risk_score", F.lit(100).cast("bigint")))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
        .withColumn("linear_score", linear_score(*cols))
    )


def with_weighted_risk(buckets: DataFrame, weights: DataFrame) -> DataFrame:
    """Linear score with weights per project (project, w_critical, w_high, w_medium, w_low)."""
    names = ["w_critical", "w_high", "w_medium", "w_low"]
    joined = join_per_project(buckets, weights.select("project", *names), ["project"], "left",
                              spread_by=["scan_id"])
    chosen = [F.coalesce(n, F.lit(d)) for n, d in zip(names, (25, 10, 3, 1))]
    return joined.withColumn(
        "weighted_score", linear_score(*[F.col(c) for c in COUNTS], weights=tuple(chosen))
    ).drop(*names)


def build_fails(fail_on: Column) -> Column:
    """Gate: any word other than critical, high and medium never fails a build."""
    c, h, m, _ = [F.col(n) for n in COUNTS]
    level = F.lower(fail_on)
    return (
        F.when(level == "critical", c > 0).when(level == "high", c + h > 0)
        .when(level == "medium", c + h + m > 0).otherwise(False))


def with_build_gate(buckets: DataFrame, policy: DataFrame) -> DataFrame:
    joined = join_per_project(buckets, policy.select("project", "fail_on"), ["project"], "left",
                              spread_by=["scan_id"])
    fail_on = F.coalesce("fail_on", F.lit("high"))
    return joined.withColumn("fail_on", fail_on).withColumn("build_fails", build_fails(F.col("fail_on")))


def severity_distribution(buckets: DataFrame) -> DataFrame:
    """One row per scan and severity that occurs, with its share of the scan's total."""
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    long = buckets.select(
        "project", "scan_id", total.alias("total"),
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("severity_rank"), F.lit(c.removesuffix("_count")).alias("severity"),
                     F.col(c).alias("n")) for i, c in enumerate(COUNTS)])))
    share = F.col("n") / F.col("total") * 100
    return long.filter(F.col("n") > 0).select(
        "project", "scan_id", "severity_rank", "severity", "n", share.alias("pct"),
        tx.one_decimal(share).cast("double").alias("pct_rounded"))
