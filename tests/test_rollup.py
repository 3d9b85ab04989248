import itertools
import json
import math
import random

import pytest
from helpers import dicts, documents, findings, runs
from pyspark.sql import functions as F

from lintharbor.operators import listing as ls
from lintharbor.operators import policy as po
from lintharbor.operators import registry, risk
from lintharbor.operators import rollup as ru
from lintharbor.plans import end_to_end as ee
from lintharbor.sinks import sarif
from lintharbor.sources import report_pass as rpp


def counts(spark, rows):
    return spark.createDataFrame(
        [("p", f"s{i}", *r) for i, r in enumerate(rows)],
        "project string, scan_id string, critical_count bigint, high_count bigint, medium_count bigint, "
        "low_count bigint")


def test_first_finding_wins(spark):
    f = findings(spark, {"seq": 5, "title": "late"}, {"seq": 2, "title": "early"}, {"seq": 9, "line": 2})
    assert [(g["seq"], g["title"]) for g in dicts(ru.dedup_findings(f), "seq")] == [(2, "early"), (9, "T")]


def test_fingerprint_rules(spark):
    f = findings(
        spark,
        {"rule_id": "", "title": "a"}, {"rule_id": "", "title": "b"},        # '' is used, not the title
        {"rule_id": None, "title": "a"}, {"rule_id": None, "title": "b"},    # absent: the title
        {"rule_id": None, "title": "a", "tool": "npm audit", "file": "package.json", "line": 0},
        {"rule_id": None, "title": "a", "tool": "npm audit", "file": "package.json", "line": 0},
        {"scan_id": "s2"}, {"project": "q"})
    assert [g["seq"] for g in dicts(ru.dedup_findings(f), "seq")] == [0, 2, 3, 4, 6, 7]
    prints = [g["fingerprint"] for g in dicts(ru.with_fingerprint(f), "seq")]
    assert prints[0] == "/srv/p/a.py:1:Bandit:" and prints[2] == "/srv/p/a.py:1:Bandit:a"


def test_dedup_is_idempotent_and_ignores_partitioning(spark):
    rnd = random.Random(1)
    rows = [{"seq": i, "line": rnd.randrange(4), "rule_id": rnd.choice(["A", "", None]),
             "title": rnd.choice("xy")} for i in range(300)]
    want = {}
    for r in rows:
        want.setdefault((r["line"], r["title"] if r["rule_id"] is None else r["rule_id"]), r["seq"])
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    for order in (rows, shuffled):
        once = ru.dedup_findings(findings(spark, *order).repartition(7))
        assert sorted(g["seq"] for g in dicts(once)) == sorted(want.values())
        assert ru.dedup_findings(once).count() == once.count()


def test_one_pass_buckets_match_dedup_then_count(spark):
    words = ["critical", "HIGH", "high", "medium", "moderate", "low", "info", "undefined", "", None]
    tools = ["Bandit", "npm audit", "pip-audit", "Secret Scanner"]
    rows = [{"severity": words[i % 10], "tool": tools[i % 4], "line": i % 9, "scan_id": f"s{i % 3}"}
            for i in range(400)]
    f = findings(spark, *rows)
    d = ru.dedup_findings(f)
    for got in dicts(ru.severity_buckets(f)):
        scan = got["scan_id"]
        expect = dict.fromkeys(("critical", "high", "medium", "low"), 0)
        for r in dicts(d.filter(F.col("scan_id") == scan)):
            word = "medium" if r["severity"] is None else r["severity"].lower()
            expect[{"moderate": "medium"}.get(word, word) if word in (*expect, "moderate") else "low"] += 1
        assert {k: got[f"{k}_count"] for k in expect} == expect
        assert got["total"] == sum(expect.values())
        mine = [r for r in rows if r["scan_id"] == scan]
        assert got["secrets_found"] == sum(r["tool"] == "Secret Scanner" for r in mine)
        assert got["outdated_dependencies"] == sum(r["tool"] in ("npm audit", "pip-audit") for r in mine)


HAND = [  # counts, raw, score, level, linear
    ((0, 0, 0, 0), 0, 0, "LOW", 0), ((0, 0, 0, 1), 3, 3, "LOW", 1), ((1, 0, 0, 0), 60, 60, "HIGH", 25),
    ((0, 1, 0, 0), 15, 15, "LOW", 10), ((0, 3, 0, 0), 30, 30, "MEDIUM", 30),
    ((0, 1, 1, 1), 25, 25, "MEDIUM", 14), ((7, 7, 7, 7), 149, 100, "CRITICAL", 100),
    ((2, 5, 10, 8), 134, 100, "CRITICAL", 100),
]


def test_scores_by_hand(spark):
    got = dicts(risk.with_risk(counts(spark, [h[0] for h in HAND])), "scan_id")
    assert [(g["raw_risk_score"], g["risk_score"], g["risk_level"], g["linear_score"]) for g in got] == [
        h[1:] for h in HAND]


def test_scores_against_plain_arithmetic_and_monotone(spark):
    grid = list(itertools.product(range(9), range(8), range(9), range(11)))
    got = {(g["critical_count"], g["high_count"], g["medium_count"], g["low_count"]): g["raw_risk_score"]
           for g in dicts(risk.with_risk(counts(spark, grid)))}

    def part(n, weight, cap):
        return min(cap, weight * math.log2(n + 1)) if n else 0

    for c, h, m, lo in grid:
        want = (50 + part(c, 10, 30) if c else 0) + part(h, 15, 40) + part(m, 7, 20) + part(lo, 3, 10)
        assert got[c, h, m, lo] == int(want)
        if h:
            assert got[c, h, m, lo] >= got[c, h - 1, m, lo]
        if lo:
            assert got[c, h, m, lo] >= got[c, h, m, lo - 1]


@pytest.mark.parametrize("fail_on,failing", [
    ("critical", {0}), ("HIGH", {0, 1}), ("medium", {0, 1, 2}), ("low", set()), ("never", set()),
    (None, {0, 1})])
def test_build_gate(spark, fail_on, failing):
    b = counts(spark, [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)])
    policy = spark.createDataFrame([("p", fail_on)], "project string, fail_on string")
    got = dicts(risk.with_build_gate(b, policy), "scan_id")
    assert {i for i, g in enumerate(got) if g["build_fails"]} == failing


def test_weights_default_per_leaf(spark):
    w = spark.createDataFrame([("p", 1, None, 2, None)],
                              "project string, w_critical int, w_high int, w_medium int, w_low int")
    (g,) = dicts(risk.with_weighted_risk(counts(spark, [(2, 1, 3, 4)]), w))
    assert g["weighted_score"] == 2 * 1 + 10 + 3 * 2 + 4


def test_severity_distribution(spark):
    got = dicts(risk.severity_distribution(counts(spark, [(2, 5, 10, 8), (0, 0, 0, 0), (0, 1, 0, 2)])),
                "scan_id", "severity_rank")
    assert [(g["severity"], g["n"], g["pct_rounded"]) for g in got] == [
        ("critical", 2, 8.0), ("high", 5, 20.0), ("medium", 10, 40.0), ("low", 8, 32.0),
        ("high", 1, 33.3), ("low", 2, 66.7)]


def test_unknown_levels_differ_per_operator(spark):
    items = spark.createDataFrame([("p", "s", 0, lv) for lv in ("HIGH", "low", "odd", None)],
                                  "project string, scan_id string, run_no bigint, issue_severity string")
    (b,) = dicts(ru.bandit_breakdown(items))
    assert (b["high"], b["medium"], b["low"]) == (1, 0, 1)
    (s,) = dicts(ru.semgrep_breakdown(items.withColumnRenamed("issue_severity", "severity")))
    assert (s["critical"], s["high"], s["medium"], s["low"]) == (0, 1, 2, 1)


def test_multi_config_result(spark):
    def report(paths, *rules):
        return {"results": [{"check_id": r, "path": "a.py", "start": {"line": 1}} for r in rules],
                "paths": {"scanned": paths}, "errors": [{"message": "e"}]}

    r = runs(
        spark, {"stdout": report(["a", "b"], "x", "y")}, {"stdout": report(["b", "c"], "y", "z")},
        {"stdout": "", "exit_code": 2, "stderr": "Semgrep is not installed"},
        {"stdout": "", "exit_code": 3, "stderr": "bad config"},
        {"stdout": "", "exit_code": 3, "stderr": "bad config", "scan_id": "only errors"}, tool="Semgrep")
    got = {g["scan_id"]: g for g in dicts(ru.semgrep_multi_config(rpp.written(rpp.tagged_rows(r))))}
    g = got["s"]
    assert (g["total_issues"], g["medium"], g["files_scanned"], g["n_errors"]) == (3, 3, 3, 3)
    assert (got["only errors"]["total_issues"], got["only errors"]["n_errors"]) == (0, 1)
    merged, paths, errors = rpp.merged_flow(rpp.written(rpp.tagged_rows(r)))
    assert merged.filter("scan_id = 's'").count() == 3 and paths.filter("scan_id = 's'").count() == 3
    assert errors.filter("scan_id = 's'").count() == 3 and dicts(errors.filter("scan_id <> 's'"))[0]["message"].startswith("Semgrep error")


def test_elapsed_time_counts_overlaps_once(spark):
    def at(*spans, scan="s"):
        return [("p", scan, float(a), float(b)) for a, b in spans]

    rows = at((0, 10), (0, 10)) + at((0, 10), (20, 25), (22, 30), (23, 24), scan="gap") + at(
        (3590, 3610), (3595, 7300), (7250, 7260), (7300, 7301), scan="hours") + [("p", "none", None, 5.0), ("p", "none", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "project string, scan_id string, a double, b double").select(
        "project", "scan_id", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("b").alias("ended_at"))
    for size in (7, 3600):
        got = {r.scan_id: r.elapsed_s for r in ru.elapsed(df, size).collect()}
        assert got == {"s": 10, "gap": 20, "hours": 3711}
    r = runs(spark, {"duration_s": 10.0}, {"duration_s": 10.0}).withColumns({
        "started_at": F.timestamp_seconds(F.lit(100)), "ended_at": F.timestamp_seconds(F.lit(110))})
    assert dicts(ee.summary_of_runs(r))[0]["scan_duration"] == "10.0 seconds"


def test_a_registered_tool_is_in_findings_sarif_and_names(spark):
    tools = registry.register_tool("Lint", "Go (Lint)", version="2.1")
    f = findings(spark, {"tool": "Lint", "rule_id": "G1"}, {"tool": "Bandit"}, {"tool": "Other"})
    assert {r["run_name"] for r in dicts(sarif.tool_partition(f, tools))} == {"Lint", "Bandit"}
    (text,) = documents(sarif.sarif_document(f, f, F.lit("/srv"), tools=tools)).values()
    drivers = [x["tool"]["driver"] for x in json.loads(text)["runs"]]
    assert [(d["name"], d["version"]) for d in drivers] == [("Bandit", "1.7.5"), ("Lint", "2.1")]
    (g,) = dicts(ru.scans_performed(runs(spark, {"tool": "Lint"}, {"tool": "Semgrep", "stdout": "{}"}), tools=tools))
    assert g["scans_performed"] == ["Semgrep SAST", "Go (Lint)"]
    shared = registry.register_tool("TSLint", run="ESLint Security")
    assert [r["run_rank"] for r in dicts(sarif.tool_partition(findings(spark, {"tool": "TSLint"}), shared))] == [2]
    assert registry.table(spark, tools).filter("tool = 'Lint'").first().label == "Go (Lint)"


def test_typescript_label_comes_from_the_project(spark):
    languages = spark.createDataFrame([("p", True), ("q", False)], "project string, typescript boolean")
    r = runs(spark, {"tool": "ESLint", "unit": "/p"}, {"tool": "ESLint", "unit": "/q/a.ts", "project": "q"},
             {"tool": "ESLint", "unit": "/z/a.ts", "project": "z"})
    got = {g["project"]: g["scans_performed"] for g in dicts(ru.scans_performed(r, languages))}
    assert got == {"p": ["JavaScript/TypeScript (ESLint)"], "q": ["JavaScript (ESLint)"], "z": ["JavaScript (ESLint)"]}


def test_run_facts_and_summary_of_clean_scans(spark):
    r = runs(
        spark,
        {"tool": "npm audit", "unit": "/a", "exit_code": 2}, {"tool": "npm audit", "unit": "/b"},
        {"tool": "ESLint", "unit": "/x/a.ts", "file_count": 4, "stdout": "[]"},
        {"tool": "Bandit", "file_count": 3, "exit_code": 2},
        {"tool": "Semgrep", "stdout": {"paths": {"scanned": ["a", "b"]}}, "duration_s": 2.25})
    (g,) = dicts(ee.scan_summary(findings(spark, {"scan_id": "other"}).limit(0), r))
    assert g["scans_performed"] == ["Python (Bandit)", "JavaScript/TypeScript (ESLint)", "Semgrep SAST",
                                    "Dependencies (npm audit)"]
    assert g["n_scans"] == 4 and g["files_scanned"] == 6
    (d,) = dicts(ru.files_scanned(r))
    assert (d["files_scanned"], d["files_distinct"]) == (6, 2)
    assert (g["total"], g["risk_score"], g["risk_level"]) == (0, 0, "LOW")
    assert g["scan_duration"] == "6.2 seconds"


def test_top_n_and_remainder(spark):
    f = findings(spark, *[{"severity": "high"} for _ in range(23)], {"severity": "low"}, {"severity": "odd"})
    got = dicts(ls.top_n_per_severity(f), "severity", "rank")
    assert [(g["severity"], g["rank"], g["seq"], g["more"]) for g in got] == [
        *[("high", i + 1, i, 13) for i in range(10)], ("low", 1, 23, 0)]


def test_priorities_cover_the_documented_steps(spark):
    f = findings(
        spark,
        {"severity": "low", "title": "Verbose error"}, {"severity": "medium", "title": "Weak md5"},
        {"severity": "low", "tool": "npm audit", "fix": "Fix available", "title": "Vulnerable package: a"},
        {"severity": "low", "tool": "npm audit", "fix": "No fix available", "title": "Vulnerable package: b"},
        {"severity": "medium", "title": "SQL injection"}, {"severity": "high", "title": "Login bypass"},
        {"severity": "critical", "title": "Anything"}, {"severity": "medium", "title": "Login page"})
    got = dicts(ls.remediation_priority(f, digit_bits=1), "vuln_id")
    assert [(g["vuln_id"], g["seq"], g["priority"]) for g in got] == [
        ("VULN-001", 6, 1), ("VULN-002", 5, 2), ("VULN-003", 4, 3), ("VULN-004", 1, 4), ("VULN-005", 2, 5),
        ("VULN-006", 0, 6), ("VULN-007", 3, 6), ("VULN-008", 7, 6)]


def test_long_ids_are_not_cut(spark):
    f = findings(spark, *[{} for _ in range(1001)])
    last = ls.remediation_priority(f).orderBy(F.desc("seq")).first()
    assert last.vuln_id == "VULN-1001"


def test_minimum_severity_and_suppressions(spark):
    f = findings(spark, {"severity": "critical"}, {"severity": "moderate", "line": 2}, {"severity": "odd", "line": 3},
                 {"severity": "low", "line": 4, "project": "q"})
    policy = spark.createDataFrame([("p", "MEDIUM")], "project string, minimum string")
    assert sorted(g["seq"] for g in dicts(po.minimum_severity(f, policy))) == [0, 1, 3]
    listed = spark.createDataFrame([("p", "/srv/p/a.py:2:Bandit:R"), ("q", "/srv/p/a.py:1:Bandit:R")],
                                   "project string, fingerprint string")
    assert sorted(g["seq"] for g in dicts(po.suppress_findings(f, listed))) == [0, 2, 3]
