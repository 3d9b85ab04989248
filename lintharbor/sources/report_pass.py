"""One pass over the reports of a run table: each report is read, checked and parsed once.

What comes out are tagged rows. `kind` is

* `run`: one row a run, with its outcome and the counts taken from its report,
* `finding`: a finding in the common shape,
* `path`: a file the data-flow scanner looked at,
* `error`: an error its report lists.

`written` keeps them as a table partitioned by kind, so each consumer reads only its rows and columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor import schemas
from lintharbor.functions import text as tx
from lintharbor.functions.scale import shared_dir
from lintharbor.sources import reports as rp
from lintharbor.sources import runs as rn

RUN_COLUMNS = ["unit", "stderr", "duration_s", "file_count"]
TIMES = ["started_at", "ended_at"]
_ROW = f"struct<kind:string,pos:int,finding:{schemas.FINDING_ITEM},path:string,message:string>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once however often they are used.

    They pass through a generator, which the optimizer does not copy into the expressions above it.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _rows(kind: str, items: Column, **fields) -> Column:
    """Tagged rows of an array; `fields` make columns of an item."""
    names = [f.split(":")[0] for f in ("kind", "pos", "finding", "path", "message")]

    def row(x: Column, i: Column) -> Column:
        values = {"kind": F.lit(kind), "pos": i, **{n: f(x) for n, f in fields.items()}}
        return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names]).cast(_ROW)

    return F.coalesce(F.transform(items, row), F.array().cast(f"array<{_ROW}>"))


def tagged_rows(runs: DataFrame, readers: dict | None = None) -> DataFrame:
    """Tagged rows of all runs, failed ones included; one projection, no shuffle."""
    readers = rp.READERS if readers is None else readers
    times = [c for c in TIMES if c in runs.columns]
    keep = [*rp.RUN_KEYS, "tool", "exit_code", *RUN_COLUMNS, *times, "target_exists", "timed_out", "stdout"]
    tool, stdout, unit = F.col("tool"), F.col("stdout"), F.col("unit")
    parsed = once(
        runs.select(*keep), valid=tx.is_json(stdout),
        flow=F.when(tool == "Semgrep", F.from_json(stdout, schemas.SEMGREP_WHOLE)))

    def branch(name: str, items, to_finding) -> Column:
        # The data-flow report is parsed already, for its findings, paths and errors together.
        found = rp.semgrep_flat(F.col("flow.results")) if (name, items) == ("Semgrep", rp.semgrep_items) else items(stdout, unit)
        return F.transform(found, lambda x, i: to_finding(x, i))

    findings = F.when(F.lit(False), F.lit(None).cast(f"array<{schemas.FINDING_ITEM}>"))
    for name, (items, to_finding) in readers.items():
        findings = findings.when(tool == name, branch(name, items, to_finding))
    stated = F.from_json(F.when(tool == "npm audit", stdout), schemas.NPM_METADATA)["metadata"]["vulnerabilities"]["total"]
    read = once(parsed, findings=findings, stated=F.coalesce(stated, F.lit(0)),
                failure=rn.tool_failure(F.col("valid")), report_error=rn.report_error())

    def n(items: Column) -> Column:
        return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))

    paths, errors = F.col("flow.paths.scanned"), F.col("flow.errors")
    run = F.array(F.struct(*[F.lit(v).alias(c) for c, v in (
        ("kind", "run"), ("pos", 0), ("finding", None), ("path", None), ("message", None))]).cast(_ROW))
    rows = F.concat(
        run, _rows("finding", F.col("findings"), finding=lambda x: x), _rows("path", paths, path=lambda x: x),
        _rows("error", errors, message=lambda e: F.coalesce(e["message"], F.to_json(e)), path=lambda e: e["path"]))
    is_run = F.col("row.kind") == "run"
    facts = {
        **{c: F.col(c) for c in (*RUN_COLUMNS, *times, "report_error")},
        "n_findings": F.when(tool == "npm audit", F.col("stated")).otherwise(n(F.col("findings"))),
        "n_paths": n(paths), "n_errors": n(errors),
    }
    return (
        read.withColumn("row", F.explode(rows))
        .select(*rp.RUN_KEYS, "tool", "exit_code", "failure",
                *[F.when(is_run, c).alias(name) for name, c in facts.items()], "row.*"))


def written(tagged: DataFrame) -> DataFrame:
    """Tagged rows as a table in the shared folder, which all consumers read instead of the reports."""
    spark = tagged.sparkSession
    folder = f"{shared_dir(spark)}/report-pass-{uuid.uuid4().hex}"
    tagged.write.partitionBy("kind").parquet(folder)
    # With its schema given, a kind that did not occur is merely empty.
    return spark.read.schema(tagged.schema).parquet(folder)


def of_kind(tagged: DataFrame, kind: str) -> DataFrame:
    return tagged.filter(F.col("kind") == kind)


def findings(tagged: DataFrame) -> DataFrame:
    """Findings of all runs that succeeded, as `reports.findings_from_runs` gives them."""
    rows = of_kind(tagged, "finding").filter(F.col("exit_code").isin(0, 1))
    return rp.as_findings(rows.select(*rp.RUN_KEYS, "tool", F.col("finding").alias("f")))


def run_rows(tagged: DataFrame) -> DataFrame:
    """One row a run."""
    return of_kind(tagged, "run").drop("kind", "pos", "finding", "path", "message")


def tool_status(tagged: DataFrame) -> DataFrame:
    return run_rows(tagged).select(
        *rp.RUN_KEYS, "tool", F.col("failure").isNull().alias("success"), F.col("failure").alias("error"))


def exit_status(tagged: DataFrame) -> DataFrame:
    """Exit code per run: 2 failed, 1 issues found, 0 clean."""
    return rn.with_exit_status(run_rows(tagged).select(
        *rp.RUN_KEYS, "tool", F.col("failure").isNotNull().alias("failed"), F.col("n_findings").alias("total_issues")))


def merged_flow(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of several rule sets over one target as one result: findings, paths and errors.

    Findings are unique by file, line and rule (no tool), the first run's first; paths are listed once.
    Errors are those the reports list and one for each run that failed, but for missing tools.
    """
    from lintharbor.functions.scale import first_per_key

    rows = tagged.filter(F.col("tool") == "Semgrep")
    done = rows.filter("failure IS NULL")
    found = rp.as_findings(of_kind(done, "finding").select(*rp.RUN_KEYS, "tool", F.col("finding").alias("f")))
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "rule_id")
    merged = first_per_key(found.withColumn("_place", place), [*schemas.SCAN_KEYS, "_place"]).drop("_place")
    paths = of_kind(done, "path").select(*schemas.SCAN_KEYS, "path").distinct()
    listed = of_kind(done, "error").select(*rp.RUN_KEYS, "pos", "message", F.coalesce("path", F.lit("")).alias("path"))
    failed = of_kind(rows, "run").filter("failure IS NOT NULL AND NOT contains(failure, 'not installed')").select(
        *rp.RUN_KEYS, F.lit(-1).alias("pos"), F.col("failure").alias("message"), F.lit("").alias("path"))
    return merged, paths, listed.unionByName(failed)
