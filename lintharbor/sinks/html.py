"""The HTML report of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.functions.text import html_escape, one_decimal
from lintharbor.operators import risk
from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks import pieces as pc

# Section headings; low findings are counted but not listed.
SECTIONS = ["🔴 Critical Vulnerabilities", "🟠 High Severity Issues", "🟡 Medium Severity Issues"]


def _txt(value: Column) -> Column:
    return value.cast("string")


def executive_summary(project: Column, total: Column, critical: Column) -> Column:
    # Report sentences.
    return F.concat(
        F.lit("Security scan completed on "), project, F.lit(". "),
        F.when(total == 0, "✅ No vulnerabilities detected. "
                           "The codebase appears to follow security best practices.")
        .otherwise(F.concat(
            F.lit("Identified "), _txt(total), F.lit(" security issues across the codebase. "),
            F.when(critical > 0, F.concat(
                F.lit("⚠️ "), _txt(critical),
                F.lit(" critical vulnerabilities require immediate attention. "))).otherwise(""),
            F.lit("Review detailed findings below and implement recommended fixes."))))


def recommendations(critical: Column, high: Column, secrets: Column, dependencies: Column,
                    medium: Column) -> Column:
    # Advice texts in report order.
    return F.array_compact(F.array(
        F.when(critical > 0, "🔴 Address all CRITICAL vulnerabilities immediately (within 24 hours)"),
        F.when(high > 0, "🟠 Remediate HIGH severity issues within 48 hours"),
        F.when(secrets > 0, "🔐 Rotate any exposed credentials and remove from codebase"),
        F.when(dependencies > 0, "📦 Update vulnerable dependencies to patched versions"),
        F.when(medium > 0, "🟡 Plan fixes for MEDIUM severity issues within 1-2 weeks"),
        F.lit("✅ Integrate security scanning into CI/CD pipeline"),
        F.lit("📚 Review OWASP Top 10 guidance for development team"),
    ))


def finding_card() -> Column:
    def safe(name: str, default: str) -> Column:
        return html_escape(F.coalesce(F.col(name), F.lit(default)))

    severity = html_escape(F.lower(F.coalesce("severity", F.lit("medium"))))
    line = F.coalesce(_txt(F.col("line")), F.lit("?"))

    def block(name: str, opening: str, closing: str) -> Column:
        shown = F.coalesce(F.col(name) != "", F.lit(False))
        return F.when(shown, F.concat(F.lit(opening), safe(name, ""), F.lit(closing))).otherwise("")

    return F.concat(
        F.lit('<article class="finding '), severity, F.lit('"><h3>'), safe("title", "Security Issue"),
        F.lit(" <em>"), severity, F.lit("</em></h3><p>"), safe("description", ""),
        F.lit("</p><p>📁 "), safe("file", "Unknown"), F.lit(":"), line, F.lit("</p>"),
        block("code", "<pre>", "</pre>"), block("fix", "<p>Fix: ", "</p>"), F.lit("</article>"))


def html_sections(findings: DataFrame, chunk_bits: int = pc.CHUNK_BITS) -> DataFrame:
    """Cards of critical, high and medium findings as pieces, framed per section."""
    rank = sev.bucket_rank(sev.severity_bucket(F.col("severity")))
    shown = findings.withColumn("slot", rank + 1).filter(F.col("slot") <= len(SECTIONS))
    cards = shown.select(*SCAN_KEYS, "seq", "slot", finding_card().alias("text"))
    heading = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("slot"))
    frames = pc.frame_pieces(
        shown.select(*SCAN_KEYS, "slot").distinct(),
        (F.col("slot"), 0, F.concat(F.lit("<section><h2>"), heading, F.lit("</h2>"))),
        (F.col("slot"), 2, F.lit("</section>")))
    return frames.unionByName(pc.chunk_pieces(cards, 1, glue="\n", chunk_bits=chunk_bits))


def severity_chart() -> Column:
    counts = [F.col(c) for c in risk.COUNTS]
    total = counts[0] + counts[1] + counts[2] + counts[3]

    def bar(name: str, n: Column) -> Column:
        pct = one_decimal(n / total * 100).cast("double")
        return F.when(n > 0, F.concat(
            F.lit(f'<div class="bar {name.lower()}" style="width: '), _txt(pct), F.lit(f'%">{name}: '),
            _txt(n), F.lit(" ("), _txt(pct), F.lit("%)</div>")))

    bars = F.array_compact(F.array(*[
        bar(b.capitalize(), n) for b, n in zip(sev.BUCKETS, counts)]))
    return F.when(total == 0, "<p>No vulnerabilities detected ✅</p>").otherwise(
        F.array_join(bars, "\n"))


def html_report(findings: DataFrame, summary: DataFrame,
                chunk_bits: int = pc.CHUNK_BITS) -> DataFrame:
    """Report pages as pieces; `summary` carries one row per page (see plans.end_to_end)."""
    c, h, m, lo = [F.col(n) for n in risk.COUNTS]
    total = c + h + m + lo
    score = risk.linear_score(c, h, m, lo)
    advice = recommendations(c, h, F.col("secrets_found"), F.col("outdated_dependencies"), m)

    def card(label: str, value: Column) -> Column:
        return F.concat(F.lit(f'<div class="card"><h3>{label}</h3><b>'), _txt(value), F.lit("</b></div>"))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<p><strong>{label}:</strong> "), html_escape(_txt(value)), F.lit("</p>"))

    name = html_escape(F.col("project_name"))
    head = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>'), name,
        F.lit("</title></head><body><h1>Security Assessment Report</h1><p>"), name,
        F.lit("</p><p>Generated: "), F.col("timestamp"), F.lit("</p>"),
        card("Total Vulnerabilities", total), card("Critical Issues", c),
        card("Files Scanned", F.col("files_scanned")), card("Risk Score", score),
        F.lit("<h2>Severity Distribution</h2>"), severity_chart(),
        F.lit("<h2>Executive Summary</h2><p>"),
        html_escape(executive_summary(F.col("project_name"), total, c)),
        F.lit('</p><p class="'), risk.risk_class(score), F.lit('">'), _txt(score), F.lit("/100 "),
        html_escape(risk.risk_description(score)), F.lit("</p>"))
    tail = F.concat(
        F.lit("<h2>Recommendations</h2><ul>"),
        F.array_join(F.transform(advice, lambda a: F.concat(F.lit("<li>"), a, F.lit("</li>"))), "\n"),
        F.lit("</ul><h2>Scan Details</h2>"),
        line("Target", F.col("target_path")),
        line("Scan Tools", F.array_join("scans_performed", ", ")),
        line("Scan Duration", F.col("scan_duration")),
        line("Languages Detected", F.array_join("languages", ", ")),
        F.lit("</body></html>"))
    ends = pc.frame_pieces(summary, (0, 0, head), (len(SECTIONS) + 1, 0, tail))
    return ends.unionByName(html_sections(findings, chunk_bits))
