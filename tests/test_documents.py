import glob
import html as pyhtml
import json
import os
import re

import pytest
from helpers import dicts, documents, findings, runs
from pyspark.sql import functions as F

from lintharbor.functions.scale import dense_numbers
from lintharbor.operators import detect as dt
from lintharbor.operators import registry
from lintharbor.operators import rollup as ru
from lintharbor.plans import end_to_end as ee
from lintharbor.sinks import html, json_doc, pieces, sarif
from lintharbor.sinks.single_file import write_files
from lintharbor.sources import reports, saved


def root(path):
    return F.lit(path)


def sarif_of(spark, f, target="/srv/p", **kw):
    docs = documents(sarif.sarif_document(f, f, root(target), **kw))
    return {k: json.loads(v) for k, v in docs.items()}


def test_embedded_sarif_example(spark):
    f = findings(
        spark,
        {"rule_id": "B608", "title": "SQL Injection", "severity": "high", "line": 45, "column": 5,
         "file": "/home/user/project/app/database.py", "code": 'cursor.execute(f"SELECT {x}")', "fix": "Use parameters"},
        {"tool": "Secret Scanner", "rule_id": None, "severity": "critical", "line": 12, "column": None,
         "file": "/home/user/project/config.py", "title": None, "code": None, "fix": None},
    ).withColumns({"type": F.when(F.col("seq") == 1, "AWS Access Key"),
                   "message": F.when(F.col("seq") == 1, "Hardcoded AWS credentials found"),
                   "category": F.when(F.col("seq") == 0, "injection")})
    (doc,) = sarif_of(spark, f, "/home/user/project").values()
    assert doc["version"] == "2.1.0" and [r["tool"]["driver"]["name"] for r in doc["runs"]] == [
        "Bandit", "Secret Scanner"]
    first, second = doc["runs"]
    result, rule = first["results"][0], first["tool"]["driver"]["rules"][0]
    assert (result["ruleId"], result["level"], rule["properties"]["security-severity"]) == ("B608", "error", "7.5")
    place = result["locations"][0]["physicalLocation"]
    assert place["artifactLocation"] == {"uri": "app/database.py", "uriBaseId": "%SRCROOT%"}
    assert place["region"] == {"startLine": 45, "startColumn": 5,
                               "snippet": {"text": 'cursor.execute(f"SELECT {x}")'}}
    assert rule["properties"]["tags"] == ["security", "injection"]
    assert first["tool"]["driver"]["version"] == "1.7.5" and second["tool"]["driver"]["version"] == "1.0.0"
    result, rule = second["results"][0], second["tool"]["driver"]["rules"][0]
    assert result["ruleId"] == rule["id"] == rule["name"] == "AWS Access Key"
    assert result["message"]["text"] == "Hardcoded AWS credentials found"
    assert result["locations"][0]["physicalLocation"]["region"] == {"startLine": 12, "startColumn": 1}
    assert rule["help"] == {"text": "Review and remediate this security issue", "markdown": ""}
    assert rule["properties"]["security-severity"] == "9.5" and rule["properties"]["tags"] == ["security", "general"]


def test_sarif_runs_rules_and_clean_scans(spark):
    f = findings(
        spark, {"tool": "pip-audit"}, {"tool": "npm audit", "rule_id": None, "description": "first"},
        {"tool": "Secret Scanner", "rule_id": None}, {"tool": "ESLint", "rule_id": None, "description": "second"},
        {"tool": "Custom"}, {"tool": "npm audit", "rule_id": "X", "severity": None})
    scans = f.select("project", "scan_id").unionByName(
        spark.createDataFrame([("p", "clean")], "project string, scan_id string"))
    docs = {k: json.loads(v) for k, v in documents(sarif.sarif_document(
        f, scans, root("/srv/p"), information_uri="https://tool.test", chunk_bits=1)).items()}
    assert docs["p", "clean"]["runs"] == []
    got = docs["p", "s"]["runs"]
    assert [r["tool"]["driver"]["name"] for r in got] == ["ESLint Security", "Secret Scanner", "pip-audit"]
    assert got[0]["tool"]["driver"]["informationUri"] == "https://tool.test"
    rules = got[0]["tool"]["driver"]["rules"]
    assert [(r["id"], r["shortDescription"]["text"]) for r in rules] == [("UNKNOWN", "first"), ("X", "D")]
    assert rules[1]["defaultConfiguration"]["level"] == "note"
    assert rules[1]["properties"]["security-severity"] == "5.0"
    assert len(got[0]["results"]) == 3 and sum(len(r["results"]) for r in got) == 5


def test_uris(spark):
    cases = [
        ("/srv/p/a/b.py", "/srv/p", "a/b.py"), ("/srv/pq/b.py", "/srv/p", "b.py"), ("/srv/p/x.py", "/srv/p/", "x.py"),
        ("", "/srv/p", "unknown"), (None, "/srv/p", "unknown"), ("unknown", "/srv/p", "unknown"),
        ("package.json", "/srv/p", "package.json"), ("app/x.py", ".", "app/x.py"), ("./app/x.py", ".", "app/x.py"),
        ("/abs/x.py", ".", "x.py"), ("/srv/p", "/srv/p", ".")]
    from lintharbor.functions.text import relative_uri

    df = spark.createDataFrame([(i, f, r) for i, (f, r, _) in enumerate(cases)], "i int, f string, r string")
    got = dicts(df.select("i", relative_uri(F.col("f"), F.col("r")).alias("u")), "i")
    assert [g["u"] for g in got] == [c[2] for c in cases]


def test_chunks_never_change_a_document(spark):
    f = findings(spark, *[
        {"seq": (i * 37) % 1000, "severity": ["critical", "high", "medium", "low"][i % 4],
         "tool": ["Bandit", "npm audit", "Semgrep"][i % 3], "rule_id": f"R{i % 7}", "scan_id": f"s{i % 2}",
         "line": i, "description": 'quote " and \\ and \n line', "code": "<b>" if i % 5 else ""}
        for i in range(200)])
    summary = ru.severity_buckets(f).withColumn("project_name", F.col("project"))
    whole = {b: documents(sarif.sarif_document(f, f, root("/srv/p"), chunk_bits=b)) for b in (1, 4, 20)}
    assert whole[1] == whole[4] == whole[20]
    lists = {b: documents(json_doc.json_document(f, summary, chunk_bits=b)) for b in (1, 4, 20)}
    assert lists[1] == lists[4] == lists[20]
    assert sarif.sarif_document(f, f, root("/"), chunk_bits=4).groupBy(
        "project", "scan_id", "slot", "section", "chunk").count().filter("count > 1").count() == 0
    for (_, scan), text in lists[4].items():
        doc = json.loads(text)
        mine = sorted((r for r in dicts(f) if r["scan_id"] == scan), key=lambda r: r["seq"])
        assert [v["description"] for v in doc["all_vulnerabilities"]] == [r["description"] for r in mine]
        for word in ("critical", "high", "medium", "low"):
            assert [v["rule_id"] for v in doc[f"{word}_vulnerabilities"]] == [
                r["rule_id"] for r in mine if r["severity"] == word]
            assert doc[f"{word}_count"] == len(doc[f"{word}_vulnerabilities"])
        assert "cwe" not in doc["all_vulnerabilities"][0] and "\n" not in text


def test_html_sections(spark):
    f = findings(
        spark, {"severity": "critical", "title": "<b>'x'</b>", "description": 'a & "b"', "code": "c<d", "fix": ""},
        {"severity": "critical", "code": "", "fix": "Do & don't"}, {"severity": "low"}, {"severity": "moderate"})
    (page,) = documents(html.html_sections(f, chunk_bits=0)).values()
    assert page.count("<article") == 3 and page.count("<section>") == page.count("</section>") == 2
    assert "&lt;b&gt;&#x27;x&#x27;&lt;/b&gt;" in page and "a &amp; &quot;b&quot;" in page
    assert "<pre>c&lt;d</pre>" in page and "<p>Fix: Do &amp; don&#x27;t</p>" in page
    assert page.count("<pre>") == 1 and page.count("Fix:") == 1
    assert page.index("Critical") < page.index("Medium Severity")


def test_escape_equals_the_standard_one(spark):
    from lintharbor.functions.text import html_escape

    text = "&lt; <a href=\"x\">'&amp;'</a> &&"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(html_escape(F.col("t"))).first()[0] == pyhtml.escape(text)


def page_row(spark, c, h, m, lo, **more):
    row = {"project": "p", "scan_id": "s", "critical_count": c, "high_count": h, "medium_count": m, "low_count": lo,
           "secrets_found": 0, "outdated_dependencies": 0, "files_scanned": 150, "project_name": "My & App",
           "timestamp": "2024-01-01", "target_path": "/path", "scans_performed": ["Bandit"],
           "scan_duration": "45 seconds", "languages": ["Python", "TypeScript"], **more}
    kinds = {int: "bigint", str: "string", list: "array<string>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


def test_html_report_of_the_embedded_example(spark):
    f = findings(spark, {"severity": "critical"})
    (page,) = documents(html.html_report(f, page_row(spark, 2, 5, 10, 8))).values()
    assert "<b>25</b>" in page and "<b>150</b>" in page and ">100/100 " in page and 'class="risk-high"' in page
    assert [float(x) for x in re.findall(r"\((\d+\.\d)%\)", page)] == [8.0, 20.0, 40.0, 32.0]
    assert "Identified 25 security issues" in page and "2 critical vulnerabilities require" in page
    assert "My &amp; App" in page and "Languages Detected:</strong> Python, TypeScript" in page
    assert "Rotate any exposed" not in page and "Update vulnerable" not in page
    (page,) = documents(html.html_report(f.limit(0), page_row(
        spark, 0, 0, 0, 0, secrets_found=1, outdated_dependencies=2))).values()
    assert "No vulnerabilities detected ✅" in page and "Rotate any exposed" in page and "Update vulnerable" in page
    assert page.count("<li>") == 4 and "<article" not in page


def test_publish_writes_what_the_policy_asks_for(spark, tmp_path):
    report = {"results": [{"test_id": f"B{i}", "test_name": "n", "issue_severity": "HIGH", "filename": "/srv/p/a.py",
                           "line_number": i, "issue_text": "t"} for i in range(40)]}
    r = runs(spark, {"stdout": report}, {"stdout": report}, {"stdout": "[]", "project": "clean", "tool": "ESLint"})
    targets = spark.createDataFrame(
        [(p, f"/srv/{p}", "2024-01-01T00:00:00", ["Python"]) for p in ("p", "clean")],
        "project string, target_path string, timestamp string, languages array<string>")
    policy = spark.createDataFrame([("p", ["json", "sarif", "html"], None), ("clean", ["json"], "all.json")],
                                   "project string, formats array<string>, json_file string")
    ee.publish(r, targets, policy, str(tmp_path))
    assert sorted(f.removeprefix(f"{tmp_path}/") for fmt in ("json", "html", "sarif")
                  for f in glob.glob(f"{tmp_path}/{fmt}/**", recursive=True) if os.path.isfile(f)) == [
        "html/project=p/scan_id=s/security-report.html", "json/project=clean/scan_id=s/all.json",
        "json/project=p/scan_id=s/security-results.json", "sarif/project=p/scan_id=s/security-results.sarif"]

    def read(fmt, project):
        files = glob.glob(f"{tmp_path}/{fmt}/project={project}/scan_id=s/*")
        return "".join(open(f, encoding="utf-8").read() for f in files)

    doc = json.loads(read("json", "p"))
    assert doc["project_name"] == "p" and doc["high_count"] == 40 == len(doc["all_vulnerabilities"])
    assert doc["scan_duration"] == "2.0 seconds" and doc["scans_performed"] == ["Python (Bandit)"]
    assert json.loads(read("json", "clean"))["all_vulnerabilities"] == []
    results = json.loads(read("sarif", "p"))["runs"][0]["results"]
    assert len(results) == 40 and results[3]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.py"
    assert read("html", "p").count("<article") == 40
    assert read("html", "clean") == read("sarif", "clean") == ""
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 40


def test_policy_thresholds_suppressions_weights_and_detection_in_publish(spark, tmp_path):
    def report(*levels):
        return {"results": [{"test_id": f"B{i}", "test_name": "n", "issue_severity": level, "filename": "/srv/p/a.py",
                             "line_number": i, "issue_text": "t"} for i, level in enumerate(levels)]}

    r = runs(spark, {"stdout": report("HIGH", "HIGH", "LOW", "MEDIUM")}, {"stdout": report("LOW"), "project": "q"},
             {"stdout": "a.go:3:G1", "tool": "Lint"})
    targets = spark.createDataFrame([(p, f"/srv/{p}", "t", ["TypeScript"]) for p in "pq"],
                                    "project string, target_path string, timestamp string, languages array<string>")
    policy = spark.createDataFrame(
        [("p", ["json", "sarif"], "medium", "critical", 7), ("q", ["json"], None, "low", None)],
        "project string, formats array<string>, minimum string, fail_on string, w_high int")
    suppressed = spark.createDataFrame([("p", "/srv/p/a.py:1:Bandit:B1")], "project string, fingerprint string")
    secret = "AKIA" + "Z9" * 8
    code = spark.createDataFrame([("p", "s", "/srv/p/k.py", f"x\n{secret} {secret}")], "project string, scan_id string, path string, text string")
    found = dt.as_findings(dt.secret_detection(dense_numbers(code, ["project", "scan_id"], ["path"], "file_no")), "Secret Scanner")
    readers = reports.register_reader("Lint", lambda out, unit: F.transform(F.split(out, "\n"), lambda x: F.create_map(
        F.lit("file"), F.split_part(x, F.lit(":"), F.lit(1)), F.lit("rule_id"), F.split_part(x, F.lit(":"), F.lit(3)))))
    ee.publish(r, targets, policy, str(tmp_path), readers=readers, tools=registry.register_tool("Lint", "Go (Lint)"),
               detected=found, suppressions=suppressed)
    doc = json.load(open(f"{tmp_path}/json/project=p/scan_id=s/security-results.json"))
    assert [(v["tool"], v.get("rule_id"), v["line"], v.get("column")) for v in doc["all_vulnerabilities"]] == [
        ("Bandit", "B0", 0, 1), ("Bandit", "B3", 3, 1), ("Lint", "G1", 0, 1), ("Secret Scanner", None, 2, 1)]
    assert (doc["high_count"], doc["critical_count"], doc["medium_count"], doc["low_count"]) == (1, 1, 2, 0)
    assert doc["scans_performed"] == ["Python (Bandit)", "Go (Lint)"]
    drivers = [x["tool"]["driver"]["name"] for x in json.load(open(f"{tmp_path}/sarif/project=p/scan_id=s/security-results.sarif"))["runs"]]
    assert drivers == ["Bandit", "Secret Scanner", "Lint"]
    summary = {x.project: x for x in spark.read.parquet(f"{tmp_path}/summary").collect()}
    assert (summary["p"].weighted_score, summary["p"].build_fails, summary["q"].build_fails) == (25 + 7 + 6, True, False)
    assert json.load(open(f"{tmp_path}/json/project=q/scan_id=s/security-results.json"))["low_count"] == 1


def test_saved_results_give_the_same_sarif(spark, tmp_path):
    f = findings(spark, *[
        {"tool": ["Bandit", "npm audit", "Semgrep", "Secret Scanner"][i % 4], "rule_id": [f"R{i % 7}", None][i % 5 == 4], "scan_id": f"s {i % 2}/é",
         "severity": ["critical", "high", "low"][i % 3], "line": i, "code": 'x":[\n"y' if i % 3 else "", "file": f"/srv/p/f{i % 9}.py",
         "description": 'ends with ":[', "title": "{T}"} for i in range(900)])
    scans = f.select("project", "scan_id").distinct()
    summary = scans.unionByName(spark.createDataFrame([("p", "clean")], "project string, scan_id string")).withColumn("target_path", F.lit("/srv/p"))
    names = summary.withColumn("file", F.concat(F.lit("result-"), F.length("scan_id"), F.lit(".json")))
    direct = documents(sarif.sarif_document(f, scans, root("/srv/p"), chunk_bits=4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a document in many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for folder, write in (("one", lambda p, at: pieces.write_named_documents(p, names, at)), ("many", pieces.write_documents)):
            write(json_doc.json_document(f, summary, chunk_bits=3), f"{tmp_path}/{folder}")
            results = saved.read_written_results(spark, f"{tmp_path}/{folder}")
            again = saved.results_as_findings(results).cache()
            assert again.count() == 900 and {r.target_path for r in results.select("target_path").collect()} == {"/srv/p"}
            assert documents(sarif.sarif_document(again, scans, root("/srv/p"), chunk_bits=4)) == direct
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/one", wholetext=True)
    docs = whole.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("document"))
    assert saved.read_results_doc(docs).count() == 900 and saved.unreadable_documents(docs).count() == 0
    read = saved.results_as_findings(saved.read_results_doc(docs)).cache()
    texts = documents(sarif.sarif_document(read, read, root("/srv/p"), chunk_bits=4)).values()
    assert sorted(texts) == sorted(direct.values())


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("d"), F.col("id") % 5).alias("folder"), F.lit("x.json").alias("file"), F.col("id").cast("string").alias("text"), "id")
    write_files(rows, str(tmp_path), ["id"])
    written = {p: open(p).read() for p in glob.glob(f"{tmp_path}/*/x.json")}
    assert {p: [int(x) % 5 for x in t.split()] for p, t in written.items()} == {f"{tmp_path}/d{i}/x.json": [i] * 80 for i in range(5)}
    assert all([int(x) for x in t.split()] == sorted(int(x) for x in t.split()) for t in written.values())
    assert sorted(os.listdir(tmp_path)) == [f"d{i}" for i in range(5)]
    # A task that dies in the middle of a document: nothing is left of this write, the former files stay.
    broken = rows.withColumn("text", F.when(F.col("id") == 333, F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="killed"):
        write_files(broken, str(tmp_path), ["id"])
    assert {p: open(p).read() for p in glob.glob(f"{tmp_path}/*/*")} == written
    assert sorted(os.listdir(tmp_path)) == [f"d{i}" for i in range(5)]


def test_write_documents_splits_large_scans(spark, tmp_path):
    f = findings(spark, *[{"description": f"d{i} " * 50, "scan_id": f"s{i % 2}"} for i in range(2000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces.write_documents(sarif.sarif_document(f, f, root("/srv/p"), chunk_bits=3), f"{tmp_path}/d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The sort by the whole piece key is the one right below the write.
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = store.apply(store.size() - 1).physicalPlanDescription()
    sort = re.findall(r"Arguments: (\[project#\d+ ASC[^]]*\]), false", plan)[-1]
    assert re.sub(r"#\d+L? ASC NULLS FIRST", "", sort) == "[project, scan_id, slot, section, chunk]"
    for scan in (0, 1):
        files = sorted(glob.glob(f"{tmp_path}/d/project=p/scan_id=s{scan}/part-*"))
        assert len(files) > 1
        doc = json.loads("".join(open(x, encoding="utf-8").read() for x in files))
        assert [r["message"]["text"].split()[0] for r in doc["runs"][0]["results"]] == [
            f"d{i}" for i in range(scan, 2000, 2)]
