"""Tool report readers.

Every tool has three pieces:

* ``<tool>_items(stdout, unit)``: the report's findings as an array column,
* ``<tool>_finding(item, pos)``: one item as a normalised finding struct,
* ``read_<tool>(runs)``: one row per raw item, for use on its own.

The first two are plain column expressions. :func:`findings_from_runs` dispatches on the tool
inside one projection, so all reports are read and parsed in a single pass over the run table
with no shuffle, and a reader added with :func:`register_reader` joins that same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintharbor import schemas
from lintharbor.functions import severity as sev
from lintharbor.functions import text as tx

RUN_KEYS = ["project", "scan_id", "run_no"]

Items = Callable[[Column, Column], Column]
ToFinding = Callable[[Column, Column], Column]


def _strings() -> Column:
    return F.array().cast("array<string>")


def finding_item(
    pos: Column,
    severity: Column,
    title: Column,
    description: Column,
    file: Column,
    line: Column,
    code: Column,
    fix: Column,
    column: Column | None = None,
    rule_id: Column | None = None,
    cwe: Column | None = None,
    owasp: Column | None = None,
    references: Column | None = None,
    is_taint: Column | None = None,
) -> Column:
    """Finding struct in the common shape (schemas.FINDING_ITEM); omitted fields are absent (NULL)."""
    absent = F.lit(None)
    values = {
        "pos": pos, "severity": severity, "title": title, "description": description,
        "file": file, "line": line, "column": absent if column is None else column, "code": code,
        "fix": fix, "rule_id": absent if rule_id is None else rule_id,
        "cwe": absent if cwe is None else cwe, "owasp": absent if owasp is None else owasp,
        "references": absent if references is None else references,
        "is_taint": F.lit(False) if is_taint is None else is_taint,
    }
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(schemas.FINDING_ITEM)


def pick(raw: Column, *names: str, default: str) -> Column:
    """First key that is present in a raw finding map, even if its value is null or ''."""
    chain = reduce(
        lambda c, n: c.when(F.map_contains_key(raw, n), raw.getItem(n)), names[1:],
        F.when(F.map_contains_key(raw, names[0]), raw.getItem(names[0])))
    return chain.otherwise(F.lit(default))


def generic_finding(raw: Column, pos: Column) -> Column:
    """Finding from a raw map<string,string> by the fallback chains of the common format."""
    return finding_item(
        pos=pos,
        severity=sev.first_truthy(raw.getItem("severity"), raw.getItem("issue_severity"),
                                  default="medium"),
        title=pick(raw, "title", "test_name", "ruleId", default="Security Issue"),
        description=pick(raw, "description", "issue_text", "message", default=""),
        file=pick(raw, "file", "filename", default="unknown"),
        line=pick(raw, "line", "line_number", default="0").try_cast("int"),
        column=pick(raw, "column", "col_offset", default="1").try_cast("int"),
        code=pick(raw, "code", "line_content", default=""),
        fix=pick(raw, "fix", "more_info", default=""),
        rule_id=pick(raw, "rule_id", "test_id", "ruleId", default=""),
    )


# --- Python code scanner -------------------------------------------------------------------

def bandit_items(stdout: Column, unit: Column) -> Column:
    return F.from_json(stdout, schemas.BANDIT_REPORT)["results"]


def read_bandit(runs: DataFrame) -> DataFrame:
    fields = ["test_id", "test_name", "issue_severity", "issue_confidence", "issue_text",
              "filename", "line_number", "col_offset", "code", "more_info"]
    raw = _explode_items(runs, "Bandit", bandit_items)
    item = F.col("item")
    return raw.select(*RUN_KEYS, "pos", *[
        (item.getItem(f).try_cast("int") if f in ("line_number", "col_offset") else item.getItem(f))
        .alias(f) for f in fields])


# --- Python dependency audit ---------------------------------------------------------------

def pip_dependencies(stdout: Column) -> Column:
    """Both report forms: a bare list, or an object holding the list."""
    return F.when(F.ltrim(stdout).startswith("["), F.from_json(stdout, schemas.PIP_LIST)).otherwise(
        F.from_json(stdout, schemas.PIP_OBJECT)["dependencies"])


def pip_audit_items(stdout: Column, unit: Column) -> Column:
    def of_dependency(dep: Column) -> Column:
        def of_vuln(v: Column) -> Column:
            vuln_id = tx.text_or(v["id"], "UNKNOWN")
            return F.struct(
                tx.text_or(dep["name"], "unknown").alias("package"),
                tx.text_or(dep["version"], "unknown").alias("installed_version"),
                vuln_id.alias("vulnerability_id"),
                sev.pip_audit_severity(vuln_id, v["aliases"]).alias("severity"),
                F.coalesce(v["description"], F.concat(F.lit("Vulnerability "), vuln_id))
                .alias("description"),
                F.coalesce(v["fix_versions"], _strings()).alias("fix_versions"),
                F.coalesce(v["aliases"], _strings()).alias("aliases"),
                tx.text_or(unit, "requirements.txt").alias("source_file"),
            )
        return F.transform(dep["vulns"], of_vuln)

    vulnerable = F.filter(pip_dependencies(stdout), lambda d: F.size(d["vulns"]) > 0)
    return F.flatten(F.transform(vulnerable, of_dependency))


def pip_audit_finding(v: Column, pos: Column) -> Column:
    return finding_item(
        pos=pos,
        severity=v["severity"],
        title=F.concat(F.lit("Vulnerable package: "), v["package"]),
        description=F.concat(v["vulnerability_id"], F.lit(": "), v["description"]),
        file=v["source_file"],
        line=F.lit(0),
        code=F.concat(v["package"], F.lit("=="), v["installed_version"]),
        fix=F.when(F.size(v["fix_versions"]) > 0,
                   F.concat(F.lit("Upgrade to: "), F.array_join(v["fix_versions"], ", ")))
        .otherwise("No fix available"),
        rule_id=v["vulnerability_id"],
    )


def read_pip_audit(runs: DataFrame) -> DataFrame:
    return _explode_items(runs, "pip-audit", pip_audit_items).select(*RUN_KEYS, "pos", "item.*")


def read_pip_dependencies(runs: DataFrame) -> DataFrame:
    """Every audited dependency with its number of advisories."""
    return (
        runs.filter(F.col("tool") == "pip-audit")
        .select(*RUN_KEYS, "unit", F.explode(pip_dependencies(F.col("stdout"))).alias("d"))
        .select(*RUN_KEYS, "unit", F.col("d.name").alias("package"),
                F.col("d.version").alias("installed_version"),
                F.greatest(F.size("d.vulns"), F.lit(0)).alias("n_vulns"))
    )


# --- Node dependency audit -----------------------------------------------------------------

def npm_items(stdout: Column, unit: Column) -> Column:
    report = F.from_json(stdout, schemas.NPM_REPORT)["vulnerabilities"]

    def of_package(e: Column) -> Column:
        v = e["value"]
        return F.struct(
            e["key"].alias("package"),
            tx.text_or(v["severity"], "unknown").alias("severity"),
            tx.text_or(v["via"], "[]").alias("via"),
            tx.text_or(v["range"], "unknown").alias("version_range"),
            tx.text_or(v["fixAvailable"], "false").alias("fix_available"),
        )
    return F.transform(F.map_entries(report), of_package)


def npm_finding(v: Column, pos: Column) -> Column:
    return finding_item(
        pos=pos,
        severity=v["severity"],
        title=F.concat(F.lit("Vulnerable package: "), v["package"]),
        description=F.concat(F.lit("Version range: "), v["version_range"]),
        file=F.lit("package.json"),
        line=F.lit(0),
        code=F.lit(""),
        fix=F.when(tx.is_truthy_json(v["fix_available"]), "Fix available")
        .otherwise("No fix available"),
    )


def read_npm_audit(runs: DataFrame) -> DataFrame:
    return _explode_items(runs, "npm audit", npm_items).select(*RUN_KEYS, "pos", "item.*")


# --- JavaScript code scanner ---------------------------------------------------------------

def eslint_messages(stdout: Column) -> Column:
    """All messages with their file, numbered over the whole report."""
    def of_file(f: Column) -> Column:
        return F.transform(f["messages"], lambda m: F.struct(
            tx.text_or(f["filePath"], "unknown").alias("file"), m.alias("m")))

    flat = F.flatten(F.transform(F.from_json(stdout, schemas.ESLINT_REPORT), of_file))
    return F.transform(flat, lambda x, i: F.struct(
        i.alias("message_no"),
        x["file"].alias("file"),
        F.coalesce(x["m"]["line"], F.lit(0)).alias("line"),
        F.coalesce(x["m"]["column"], F.lit(0)).alias("column"),
        sev.eslint_severity(x["m"]["severity"]).alias("severity"),
        tx.text_or(x["m"]["message"], "").alias("message"),
        tx.text_or(x["m"]["ruleId"], "").alias("rule_id"),
    ))


def is_security_rule(rule_id: Column) -> Column:
    return F.coalesce(rule_id, F.lit("")).contains("security/")


def eslint_items(stdout: Column, unit: Column) -> Column:
    return F.filter(eslint_messages(stdout), lambda m: is_security_rule(m["rule_id"]))


def eslint_finding(m: Column, pos: Column) -> Column:
    return finding_item(
        pos=m["message_no"], severity=m["severity"], title=m["rule_id"], description=m["message"],
        file=m["file"], line=m["line"], column=m["column"], code=F.lit(""), fix=F.lit(""),
        rule_id=m["rule_id"],
    )


def read_eslint(runs: DataFrame) -> DataFrame:
    """Every message, before the security-rule filter."""
    return (
        _explode_items(runs, "ESLint", lambda out, unit: eslint_messages(out))
        .select(*RUN_KEYS, "item.*")
    )


# --- Data-flow scanner ---------------------------------------------------------------------

def _trace_end(raw: Column) -> Column:
    parsed = F.from_json(raw, schemas.TRACE_END)
    return F.when(tx.is_truthy_json(raw), F.struct(
        tx.text_or(parsed["location"]["path"], "").alias("file"),
        F.coalesce(parsed["location"]["start"]["line"], F.lit(0)).alias("line"),
        tx.text_or(parsed["content"], "").alias("content")))


def semgrep_items(stdout: Column, unit: Column, only: Collection[str] = ()) -> Column:
    return semgrep_flat(F.from_json(stdout, schemas.SEMGREP_REPORT)["results"], only)


def semgrep_flat(results: Column, only: Collection[str] = ()) -> Column:
    """Findings flattened to 19 fields plus the two optional data-flow ends.

    Polymorphic fields are parsed here, once per finding; everything derived from them refers to
    the parsed fields of the item. `only` names the fields to build: the optimizer cannot prune
    inside an array transform, so counting jobs ask for the few they need.
    """
    def parsed(r: Column) -> Column:
        extra, meta = r["extra"], r["extra"]["metadata"]
        trace = extra["dataflow_trace"]
        ends = F.from_json(trace, schemas.TRACE)
        return F.struct(*[c.alias(n) for n, c in {
            "rule_id": tx.text_or(r["check_id"], "unknown"),
            "title": F.coalesce(meta["shortDescription"], r["check_id"], F.lit("Security Issue")),
            "severity": sev.semgrep_severity(extra["severity"]),
            "message_text": extra["message"],
            "file": tx.text_or(r["path"], "unknown"),
            "line": F.coalesce(r["start"]["line"], F.lit(0)),
            "column": F.coalesce(r["start"]["col"], F.lit(1)),
            "end_line": F.coalesce(r["end"]["line"], F.lit(0)),
            "end_column": F.coalesce(r["end"]["col"], F.lit(1)),
            "code": tx.text_or(extra["lines"], ""),
            "fix": tx.text_or(extra["fix"], ""),
            "references": tx.as_list(meta["references"]),
            "cwe": tx.as_list(meta["cwe"]),
            "owasp": tx.as_list(meta["owasp"]),
            "confidence": tx.text_or(meta["confidence"], "MEDIUM"),
            "category": tx.text_or(meta["category"], "security"),
            "technology": tx.as_list(meta["technology"]),
            "is_taint_finding": tx.is_truthy_json(trace),
            "taint_source": F.when(trace.isNotNull(), _trace_end(ends["taint_source"])),
            "taint_sink": F.when(trace.isNotNull(), _trace_end(ends["taint_sink"])),
        }.items() if not only or n in only])

    return F.transform(results, parsed)


def semgrep_finding(f: Column, pos: Column) -> Column:
    described = tx.with_taint(
        tx.with_taxonomy(tx.text_or(f["message_text"], ""), f["cwe"], f["owasp"]),
        f["is_taint_finding"], f["taint_source"], f["taint_sink"])
    return finding_item(
        pos=pos, severity=f["severity"], title=f["title"], description=described, file=f["file"],
        line=f["line"], column=f["column"], code=f["code"], fix=f["fix"], rule_id=f["rule_id"],
        cwe=f["cwe"], owasp=f["owasp"], references=f["references"], is_taint=f["is_taint_finding"],
    )


def read_semgrep_fields(runs: DataFrame, *only: str) -> DataFrame:
    """Just the named fields of each finding."""
    return _explode_items(
        runs, "Semgrep", lambda out, unit: semgrep_items(out, unit, only)
    ).select(*RUN_KEYS, "pos", "item.*")


def read_semgrep(runs: DataFrame) -> DataFrame:
    """`message` carries the taxonomy, `description` is the bare text."""
    raw = _explode_items(runs, "Semgrep", semgrep_items).select(*RUN_KEYS, "pos", "item.*")
    text = F.col("message_text")
    return raw.withColumns({
        "message": tx.with_taxonomy(
            tx.text_or(text, "Security issue detected"), F.col("cwe"), F.col("owasp")),
        "description": tx.text_or(text, ""),
    }).drop("message_text")


def scanned_paths(runs: DataFrame) -> DataFrame:
    """One row per path a data-flow run reports as scanned (repeats kept)."""
    paths = F.from_json("stdout", schemas.SEMGREP_PATHS)["paths"]["scanned"]
    return runs.filter(F.col("tool") == "Semgrep").select(*RUN_KEYS, F.explode(paths).alias("path"))


def n_scanned_paths(stdout: Column) -> Column:
    paths = F.from_json(stdout, schemas.SEMGREP_PATHS)["paths"]["scanned"]
    return F.greatest(F.coalesce(F.size(paths), F.lit(0)), F.lit(0))


# --- Secret scanner ------------------------------------------------------------------------

def secret_items(stdout: Column, unit: Column) -> Column:
    return F.from_json(stdout, schemas.SECRETS_REPORT)["secrets"]


def secret_finding(s: Column, pos: Column) -> Column:
    """The matched text is not in the schema read above, so it cannot reach any output."""
    return finding_item(
        pos=pos,
        severity=tx.text_or(s["severity"], "high"),
        title=F.concat(F.lit("Exposed secret: "), tx.text_or(s["type"], "Unknown")),
        description=tx.text_or(s["description"], "Hardcoded secret detected"),
        file=tx.text_or(s["file"], "unknown"),
        line=F.coalesce(s["line"], F.lit(0)),
        code=F.lit("[REDACTED]"),
        fix=F.lit("Remove from code and use environment variables or secret manager"),
    )


def read_secrets(runs: DataFrame) -> DataFrame:
    return _explode_items(runs, "Secret Scanner", secret_items).select(*RUN_KEYS, "pos", "item.*")


# --- All tools at once ---------------------------------------------------------------------

READERS: dict[str, tuple[Items, ToFinding]] = {
    "Bandit": (bandit_items, generic_finding),
    "ESLint": (eslint_items, eslint_finding),
    "pip-audit": (pip_audit_items, pip_audit_finding),
    "npm audit": (npm_items, npm_finding),
    "Secret Scanner": (secret_items, secret_finding),
    "Semgrep": (semgrep_items, semgrep_finding),
}


def register_reader(
    tool: str,
    items: Items,
    to_finding: ToFinding = generic_finding,
    readers: dict[str, tuple[Items, ToFinding]] | None = None,
) -> dict[str, tuple[Items, ToFinding]]:
    """Readers plus one more tool. By default its items are raw maps read by the common chains."""
    return {**(READERS if readers is None else readers), tool: (items, to_finding)}


def _explode_items(runs: DataFrame, tool: str, items: Items) -> DataFrame:
    return runs.filter(F.col("tool") == tool).select(
        *RUN_KEYS, F.posexplode(items(F.col("stdout"), F.col("unit"))).alias("pos", "item"))


def succeeded(exit_code: Column) -> Column:
    """Orchestrator view of a run: clean or with issues; everything else failed."""
    return F.coalesce(exit_code.isin(0, 1), F.lit(False))


def as_findings(exploded: DataFrame) -> DataFrame:
    f = F.col("f")
    plain = [n for n in schemas.FINDING_COLUMNS if n not in ("project", "scan_id", "seq", "tool",
                                                             "severity")]
    return exploded.select(
        "project", "scan_id",
        (F.col("run_no") * F.lit(2**32) + f["pos"]).alias("seq"),
        "tool",
        sev.normalize_severity(f["severity"]).alias("severity"),
        *[f[n].alias(n) for n in plain],
        f["is_taint"].alias("is_taint"),
    )


def tool_findings(runs: DataFrame, tool: str,
                  readers: dict[str, tuple[Items, ToFinding]] | None = None) -> DataFrame:
    """Findings of one tool, whatever the run's outcome."""
    items, to_finding = (READERS if readers is None else readers)[tool]
    return as_findings(_explode_items(runs, tool, items).select(
        *RUN_KEYS, F.lit(tool).alias("tool"), to_finding(F.col("item"), F.col("pos")).alias("f")))


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of tables; columns a part lacks are absent (NULL).

    The findings of several tools in one run table need no union: `findings_from_runs` reads it once.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def findings_from_runs(runs: DataFrame,
                       readers: dict[str, tuple[Items, ToFinding]] | None = None,
                       any_outcome: bool = False) -> DataFrame:
    """Findings of all successful runs, or of all runs, in one pass over the run table."""
    stdout, unit = F.col("stdout"), F.col("unit")

    def branch(items: Items, to_finding: ToFinding) -> Column:
        return F.transform(items(stdout, unit), lambda x, i: to_finding(x, i))

    chosen = reduce(
        lambda c, kv: c.when(F.col("tool") == kv[0], branch(*kv[1])),
        (READERS if readers is None else readers).items(),
        F.when(F.lit(False), F.lit(None).cast(f"array<{schemas.FINDING_ITEM}>")))
    return as_findings(
        (runs if any_outcome else runs.filter(F.col("exit_code").isin(0, 1)))
        .select(*RUN_KEYS, "tool", F.explode(chosen).alias("f")))
