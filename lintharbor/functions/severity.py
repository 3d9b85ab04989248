"""Severity vocabularies: normalisation, buckets, ranks and per-tool mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes; SQL trim() only knows the space.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

BUCKETS = ("critical", "high", "medium", "low")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP_CHARS))


def first_truthy(*values: Column | str, default: str) -> Column:
    """First value that is neither NULL nor '' (Python's ``a or b or default``)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def normalize_severity(severity: Column) -> Column:
    """Lower-case, strip, fold synonyms; unknown words pass through unchanged."""
    s = strip(F.lower(severity))
    # The synonyms tools use.
    return (
        F.when(s.isin("moderate", "warning", "warn"), "medium")
        .when(s == "error", "high")
        .when(s.isin("info", "informational"), "low")
        .otherwise(s)
    )


def severity_bucket(severity: Column) -> Column:
    """Report bucket: unknown words count as low, a missing severity as medium."""
    s = F.lower(F.coalesce(severity, F.lit("medium")))
    return (
        F.when(s == "critical", "critical")
        .when(s == "high", "high")
        .when(s.isin("medium", "moderate"), "medium")
        .otherwise("low")
    )


def bucket_rank(bucket: Column) -> Column:
    """0 for critical up to 3 for low: presentation order."""
    return (
        F.when(bucket == "critical", 0).when(bucket == "high", 1).when(bucket == "medium", 2)
        .otherwise(3)
    )


def semgrep_severity(level: Column) -> Column:
    """Three-level scale of the data-flow scanner; it never yields critical."""
    s = F.upper(F.coalesce(level, F.lit("WARNING")))
    return (
        F.when(s == "ERROR", "high")
        .when(s.isin("INFO", "INVENTORY", "EXPERIMENT"), "low")
        .otherwise("medium")
    )


def eslint_severity(level: Column) -> Column:
    s = F.coalesce(level, F.lit(1))
    return F.when(s == 2, "high").when(s == 1, "medium").otherwise("low")


def pip_audit_severity(vuln_id: Column, aliases: Column) -> Column:
    """Guess from the advisory ids: CRITICAL in the id beats a GHSA alias beats medium."""
    has_ghsa = F.exists(F.coalesce(aliases, F.array().cast("array<string>")),
                        lambda a: a.contains("GHSA"))
    return (
        F.when(F.upper(vuln_id).contains("CRITICAL"), "critical")
        .when(has_ghsa, "high")
        .otherwise("medium")
    )


def sarif_level(severity: Column) -> Column:
    """A missing severity is treated as an unknown word, hence `note`."""
    s = F.lower(F.coalesce(severity, F.lit("warning")))
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise(
        "note"
    )


def sarif_score(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("medium")))
    # Fixed values of the security-severity property, written as text.
    return (
        F.when(s == "critical", "9.5").when(s == "high", "7.5").when(s == "low", "2.5")
        .when(s == "info", "0.0").otherwise("5.0")
    )
