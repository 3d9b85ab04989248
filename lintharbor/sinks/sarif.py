"""SARIF 2.1.0 results, rules and documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor.functions import severity as sev
from lintharbor.functions import text as tx
from lintharbor.functions.scale import first_per_key
from lintharbor.operators.registry import TOOLS, Tool, last_rank, run_name, run_rank, run_version
from lintharbor.schemas import SCAN_KEYS
from lintharbor.sinks import pieces as pc

SCHEMA_URI = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def tool_partition(findings: DataFrame, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """Findings with their run; tools that nobody registered are dropped."""
    ranked = findings.withColumn("run_rank", run_rank(F.col("tool"), tools)).filter("run_rank is not null")
    return ranked.withColumn("run_name", run_name(F.col("run_rank"), tools))


def rule_key(findings: DataFrame) -> Column:
    return F.coalesce(F.col("rule_id"), _optional(findings, "type"), F.lit("UNKNOWN"))


def at_least_one(value: Column) -> Column:
    """Line and column numbers start at 1; 0, NULL and negatives become 1."""
    return F.greatest(F.coalesce(value, F.lit(1)), F.lit(1))


def snippet(code: Column) -> Column:
    """Code shown in a region: nothing for empty or redacted code."""
    return F.when((code != "") & (code != "[REDACTED]"), code)


def sarif_results(findings: DataFrame, root: Column, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """One result per finding of a known tool, as columns."""
    runs = tool_partition(findings, tools)
    return runs.select(
        *[c for c in (*SCAN_KEYS, "seq", "run_rank", "run_name") if c in runs.columns],
        rule_key(runs).alias("rule_key"),
        sev.sarif_level(F.col("severity")).alias("level"),
        F.coalesce(_optional(runs, "message"), "description", F.lit("Security issue detected"))
        .alias("message_text"),
        tx.relative_uri(F.col("file"), root).alias("uri"),
        at_least_one(F.col("line")).alias("start_line"),
        at_least_one(F.col("column")).alias("start_column"),
        snippet(F.col("code")).alias("snippet_text"),
    )


def result_json() -> Column:
    region = F.struct(
        F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"),
        F.when(F.col("snippet_text").isNotNull(), F.struct(F.col("snippet_text").alias("text")))
        .alias("snippet"))
    place = F.struct(F.struct(
        F.struct(F.col("uri").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
        .alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(
        F.col("rule_key").alias("ruleId"), F.col("level").alias("level"),
        F.struct(F.col("message_text").alias("text")).alias("message"),
        F.array(place).alias("locations")))


def sarif_rules(findings: DataFrame, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """One rule per run and rule id, described by its first finding."""
    runs = tool_partition(findings, tools)
    runs = runs.withColumn("rule_key", rule_key(runs))
    first = first_per_key(runs, [*SCAN_KEYS, "run_rank", "rule_key"])
    text = F.coalesce("description", F.lit("Security vulnerability detected"))
    return first.select(
        *SCAN_KEYS, "seq", "run_rank", "run_name", "rule_key",
        F.coalesce("title", "rule_key").alias("name"),
        text.alias("description_text"),
        F.coalesce("fix", F.lit("Review and remediate this security issue")).alias("help_text"),
        F.coalesce(_optional(first, "fix_markdown"), "fix", F.lit("")).alias("help_markdown"),
        sev.sarif_level(F.col("severity")).alias("level"),
        F.coalesce(_optional(first, "category"), F.lit("general")).alias("category"),
        sev.sarif_score(F.col("severity")).alias("security_severity"),
    )


def rule_json() -> Column:
    def text(name: str) -> Column:
        return F.struct(F.col(name).alias("text"))

    return F.to_json(F.struct(
        F.col("rule_key").alias("id"), F.col("name").alias("name"),
        text("description_text").alias("shortDescription"),
        text("description_text").alias("fullDescription"),
        F.struct(F.col("help_text").alias("text"), F.col("help_markdown").alias("markdown"))
        .alias("help"),
        F.struct(F.col("level").alias("level")).alias("defaultConfiguration"),
        F.struct(F.array(F.lit("security"), F.col("category")).alias("tags"),
                 F.col("security_severity").alias("security-severity")).alias("properties")))


def sarif_document(findings: DataFrame, scans: DataFrame, root: Column,
                   information_uri: str | None = None,
                   chunk_bits: int = pc.CHUNK_BITS, tools: Sequence[Tool] = TOOLS) -> DataFrame:
    """SARIF documents as pieces, one document per scan of `scans` (project, scan_id).

    `findings` is read more than once: pass a stored table. Slots are tool runs; inside a run come
    the opening (0), rules (1), the turn to results (2), results (3) and the end (4).
    """
    results = sarif_results(findings, root, tools).withColumn("text", result_json())
    rules = sarif_rules(findings, tools).withColumn("text", rule_json())

    present = tool_partition(findings, tools).groupBy(*SCAN_KEYS).agg(
        F.sort_array(F.collect_set("run_rank")).alias("runs"))
    all_scans = scans.select(*SCAN_KEYS).distinct().join(present, SCAN_KEYS, "left")
    per_run = all_scans.select(*SCAN_KEYS, "runs", F.explode("runs").alias("run"))

    run, is_first = F.col("run"), F.col("run") == F.col("runs")[0]
    uri = F.lit("" if information_uri is None else f',"informationUri":"{information_uri}"')
    opening = F.concat(
        F.when(is_first, "").otherwise(","),
        F.lit('{"tool":{"driver":{"name":"'), run_name(run, tools), F.lit('","version":"'),
        run_version(run, tools), F.lit('"'), uri, F.lit(',"rules":['))
    parts = [
        pc.frame_pieces(
            all_scans,
            (0, 0, F.lit(f'{{"$schema":"{SCHEMA_URI}","version":"2.1.0","runs":[')),
            (last_rank(tools) + 1, 0, F.lit("]}"))),
        pc.frame_pieces(per_run, (run, 0, opening), (run, 2, F.lit(']}},"results":[')),
                        (run, 4, F.lit("]}"))),
        pc.chunk_pieces(rules.withColumnRenamed("run_rank", "slot"), 1, chunk_bits=chunk_bits),
        pc.chunk_pieces(results.withColumnRenamed("run_rank", "slot"), 3, chunk_bits=chunk_bits),
    ]
    return reduce(DataFrame.unionByName, parts)
