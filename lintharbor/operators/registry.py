"""The tools a scan may run: their SARIF run, their name in reports and their place in both.

The list is known when a query is planned, so tools are looked up in literals, without a join. A tool
added with `register_tool`, beside its reader, appears in findings, SARIF and scan names alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    name: str
    run: str                 # SARIF run that takes its findings
    version: str
    rank: int                # order of the run in a document
    label: str | None = None  # name among the scans performed
    order: int | None = None  # place among them


# Run order, names and versions, and the display names of the scans in plan order.
TOOLS = (
    Tool("Bandit", "Bandit", "1.7.5", 1, "Python (Bandit)", 1),
    Tool("pip-audit", "pip-audit", "1.0.0", 5, "Python Dependencies (pip-audit)", 2),
    Tool("ESLint", "ESLint Security", "1.0.0", 2, "JavaScript (ESLint)", 3),
    Tool("ESLint Security", "ESLint Security", "1.0.0", 2),
    Tool("Secret Scanner", "Secret Scanner", "1.0.0", 3, "Secrets Detection", 4),
    Tool("Semgrep", "Semgrep", "1.0.0", 4, "Semgrep SAST", 5),
    Tool("npm audit", "ESLint Security", "1.0.0", 2, "Dependencies (npm audit)", 6),
)
ESLINT_WITH_TYPESCRIPT = "JavaScript/TypeScript (ESLint)"


def register_tool(name: str, label: str | None = None, run: str | None = None, version: str = "1.0.0",
                  tools: Sequence[Tool] = TOOLS) -> tuple[Tool, ...]:
    """`tools` plus one, in the SARIF run of that name or in a new one behind the others."""
    run = run or name
    same = [t for t in tools if t.run == run]
    rank = same[0].rank if same else max(t.rank for t in tools) + 1
    order = max(t.order or 0 for t in tools) + 1
    added = Tool(name, run, same[0].version if same else version, rank, label or name, order)
    return (*[t for t in tools if t.name != name], added)


def table(spark: SparkSession, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """(tool, run, version, rank, label, place): one row a tool."""
    return spark.createDataFrame(
        [(t.name, t.run, t.version, t.rank, t.label, t.order) for t in tools],
        "tool string, run string, version string, rank int, label string, place int")


def _looked_up(key: Column, pairs: dict, kind: str) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast(kind))
    for k, v in pairs.items():
        chain = chain.when(key == k, F.lit(v))
    return chain


def run_rank(tool: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    """Number of the run a tool belongs to; NULL for tools nobody registered."""
    return _looked_up(tool, {t.name: t.rank for t in tools}, "int")


def run_name(rank: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    return _looked_up(rank, {t.rank: t.run for t in tools}, "string")


def run_version(rank: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    return _looked_up(rank, {t.rank: t.version for t in tools}, "string")


def last_rank(tools: Sequence[Tool] = TOOLS) -> int:
    return max(t.rank for t in tools)


def scan_label(has_typescript: Column) -> Column:
    return F.when(has_typescript, ESLINT_WITH_TYPESCRIPT).otherwise("JavaScript (ESLint)")


def scan_name(tool: Column, has_typescript: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    """Name of the scan a tool stands for; that of the script scanner tells whether it met TypeScript."""
    named = _looked_up(tool, {t.name: t.label for t in tools if t.label and t.name != "ESLint"}, "string")
    return F.when(tool == "ESLint", scan_label(has_typescript)).otherwise(named)


def scan_order(tool: Column, tools: Sequence[Tool] = TOOLS) -> Column:
    """Place of the scan in lists of scans; NULL for tools without one."""
    return _looked_up(tool, {t.name: t.order for t in tools if t.label}, "int")
