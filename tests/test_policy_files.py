import copy
import fnmatch
import json

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from lintharbor.functions import text as tx
from lintharbor.functions.severity import normalize_severity
from lintharbor.operators import policy as po
from lintharbor.sources import files as fl

GLOBS = ["*.py", "**/node_modules/**", "src/*", "a?c", "[abc]x", "[!abc]x", "[]x]y", "[!]]z", "a[", "a.b+c(d)|e$",
         "[a-c]*[0-9]", "x\\y", "[\\]q", "[^a]b", "*", "", " *.js ", "[a&&b]x", "é*", "[]", "[!]", "[]]", "[z-a]x", "[!z-a]x",
         "[a-c-e]x", "[-a]x", "[a-]x", "[!-]x", "[z-ab]x", "[a-c[]x", "***", "[*]", "[?]x", "{a,b}", "#x y"]
PATHS = ["a.py", "src/a.py", "x/node_modules/y/z.js", "abc", "a/c", "ax", "dx", "]y", "xy", "]z", "az", "a[", "a.b+c(d)|e$",
         "b1", "b/x9", "x\\y", "\\q", "^b", "ab", "bb", "", "m.js", "&x", "bx", "évian", "a\nb.py", "[]", "[!]", "]", "-x", "ex", "zx", "[x", "*",
         "?x", "{a,b}", "#x y", "cx"]


def test_globs_agree_with_the_standard_matcher(spark):
    df = spark.createDataFrame([(g, p) for g in GLOBS for p in PATHS], "g string, p string")
    hit = F.rlike(F.col("p"), tx.any_glob_regex(F.array("g")))
    for r in df.withColumn("hit", hit).collect():
        assert r.hit == fnmatch.fnmatchcase(r.p, r.g.strip()), (r.g, r.p)


def test_glob_lists(spark):
    df = spark.createDataFrame([("a.ts", ["*.py", "*.ts"]), ("a.ts", ["*.py"]), ("a.ts", [])],
                               "p string, g array<string>")
    got = df.select(F.rlike(F.col("p"), tx.any_glob_regex(F.col("g"))).alias("h")).collect()
    assert [r.h for r in got] == [True, False, None]


def inventory(spark, *paths, root="/srv/p", project="p"):
    return fl.inventory(spark.createDataFrame([(project, root, f"{root}/{x}") for x in paths],
                                              "project string, root string, path string"))


def test_exclusion_is_by_whole_component_below_the_root(spark):
    inv = inventory(spark, "a.py", "build/a.py", "rebuild/a.py", "x/node_modules/y/a.js", "venv2/a.py", ".git/a.py",
                    root="/srv/build/p")
    kept = [g["rel_path"] for g in dicts(fl.included(inv), "path")]
    assert kept == ["a.py", "rebuild/a.py", "venv2/a.py"]


def test_languages(spark):
    inv = inventory(spark, "a.py", "b.jsx", "c.tsx", "package.json", "web/package.json", "d.md", "e.PY", "f.py.bak", ".py")
    assert {g["rel_path"]: g["language"] for g in dicts(inv)} == {
        "a.py": "python", "b.jsx": "javascript", "c.tsx": "typescript", "package.json": "package_json",
        "web/package.json": "package_json", "d.md": None, "e.PY": None, "f.py.bak": None, ".py": "python"}
    (g,) = dicts(fl.project_languages(fl.included(inv)))
    assert (g["python"], g["javascript"], g["typescript"], g["nodejs"]) == (True, True, True, True)
    assert (g["python_files"], g["js_files"], g["ts_files"], g["package_json_files"]) == (2, 1, 1, 2)
    (g,) = dicts(fl.project_languages(fl.included(inventory(spark, "c.ts"))))
    assert g["javascript"] and g["js_files"] == 0
    dirs = dicts(fl.npm_project_dirs(fl.included(inv)), "project_dir")
    assert [d["project_dir"] for d in dirs] == ["/srv/p", "/srv/p/web"]


def test_single_file_targets(spark):
    one = fl.inventory(spark.createDataFrame(
        [("a", "/srv/build/x.ts", "/srv/build/x.ts"), ("b", "/srv/package.json", "/srv/package.json")],
        "project string, root string, path string"))
    assert [(g["rel_path"], g["language"]) for g in dicts(fl.included(one))] == [("x.ts", "typescript")]


def test_manifests_in_fixed_order_top_level_only(spark):
    inv = inventory(spark, "pyproject.toml", "requirements.txt", "sub/requirements-dev.txt").unionByName(
        inventory(spark, "a.py", root="/srv/q", project="q"))
    assert [(g["project"], g["manifests"], g["n_manifests"]) for g in dicts(fl.dependency_manifests(inv), "project")] == [
        ("p", ["requirements.txt", "pyproject.toml"], 2), ("q", [], 0)]


def test_globs_filter_files(spark):
    inv = inventory(spark, "a.py", "gen/b.py", "c.js")
    globs = lambda g: spark.createDataFrame([("p", g)], "project string, globs array<string>")
    assert [g["rel_path"] for g in dicts(fl.exclude_globs(inv, globs(["gen/*"])), "path")] == ["a.py", "c.js"]
    assert [g["rel_path"] for g in dicts(fl.include_patterns(inv, globs(["*.py"])), "path")] == ["a.py", "gen/b.py"]
    assert fl.exclude_globs(inv, globs([])).count() == fl.include_patterns(inv, globs([])).count() == 3
    assert fl.exclude_globs(inv, globs(["x"]).filter("false")).count() == 3


def test_reading_real_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import pickle\npickle.loads(x)\n")
    (tmp_path / "b.txt").write_text("hello")
    listed = fl.inventory(fl.list_files(spark, f"file:{tmp_path}", "p"))
    assert sorted(g["rel_path"] for g in dicts(listed)) == ["b.txt", "src/a.py"]
    assert "content" not in listed.columns
    from lintharbor.operators.detect import vulnerable_pattern_scan

    code = fl.read_text_files(spark, f"file://{tmp_path}", "p").withColumn("language", fl.language_of(F.col("path")))
    assert [(g["line"], g["rule_id"]) for g in dicts(vulnerable_pattern_scan(code))] == [(2, "DES01")]


def merged(user):
    """Plain nested merge of the defaults with a policy."""
    base = {s: {k: json.loads(v) if v[:1] in "[tf" and v not in ("text",) else v for k, v in d.items()}
            for s, d in copy.deepcopy(po.DEFAULTS).items()}
    for key, value in (user or {}).items():
        if isinstance(base.get(key), dict) and isinstance(value, dict):
            base[key].update(value)
        else:
            base[key] = value
    return base


@pytest.mark.parametrize("user", [
    None, {}, {"scan": {"python": False}}, {"scan": {"secrets": None}}, {"scan": {"javascript": 0, "exclude": ["a", "b"]}},
    {"output": {"formats": ["json"], "verbose": True}}, {"severity": {"fail_on": "low"}, "other": {"x": 1}},
    {"scan": {"exclude": []}, "output": {"json_file": "x.json"}}])
def test_effective_policy_is_a_deep_merge(spark, user):
    projects = spark.createDataFrame([("p", None, None)], "project string, skip array<string>, cli_formats string")
    given = spark.createDataFrame([("p", None if user is None else json.dumps(user))], "project string, policy_json string")
    (got,) = dicts(po.effective_policy(projects, given))
    want = merged(user)
    assert {s: got[s] for s in po.SCANNERS} == {s: bool(want["scan"][s]) for s in po.SCANNERS}
    assert got["exclude"] == want["scan"].get("exclude", [])
    assert got["formats"] == want["output"]["formats"] and got["verbose"] == bool(want["output"]["verbose"])
    assert (got["json_file"], got["minimum"], got["fail_on"]) == (
        want["output"]["json_file"], want["severity"]["minimum"], want["severity"]["fail_on"])


def test_weights_from_the_policy_text(spark):
    from lintharbor.operators import risk

    given = spark.createDataFrame([
        ("p", '{"risk":{"weights":{"critical":50,"high":"x","low":0}}}'), ("q", "{}"), ("r", None), ("s", '{"risk":{"weights":null}}')],
        "project string, policy_json string")
    weights = po.risk_weights(given)
    got = {g["project"]: tuple(g.values())[1:] for g in dicts(weights)}
    assert got == {"p": (50, None, None, 0), "q": (None,) * 4, "r": (None,) * 4, "s": (None,) * 4}
    counts = spark.createDataFrame([(p, "s", 1, 1, 1, 1) for p in "pq"], "project string, scan_id string, critical_count bigint, "
                                   "high_count bigint, medium_count bigint, low_count bigint")
    assert {g["project"]: g["weighted_score"] for g in dicts(risk.with_weighted_risk(counts, weights))} == {"p": 63, "q": 39}


def test_switches_win(spark):
    projects = spark.createDataFrame([("p", ["python", "semgrep"], " HTML,json ,")],
                                     "project string, skip array<string>, cli_formats string")
    given = spark.createDataFrame([("p", '{"scan":{"python":true},"output":{"formats":["sarif"]}}')],
                                  "project string, policy_json string")
    policy = po.effective_policy(projects, given)
    (got,) = dicts(policy)
    assert not got["python"] and not got["semgrep"] and got["secrets"]
    assert got["formats"] == ["html", "json", ""]
    (f,) = dicts(po.selected_formats(policy))
    assert (f["write_html"], f["write_json"], f["write_sarif"], f["write_text"]) == (True, True, False, False)


def test_scan_plan(spark):
    inv = fl.included(inventory(spark, "a.py", "b.ts", "package.json", "w/package.json"))
    empty = spark.createDataFrame([("p", None, None), ("bare", None, None)],
                                  "project string, skip array<string>, cli_formats string")
    none = spark.createDataFrame([], "project string, policy_json string")
    plan = po.scan_plan(po.effective_policy(empty, none), fl.project_languages(inv), fl.npm_project_dirs(inv))
    got = [(g["project"], g["tool"], g["unit"]) for g in dicts(plan, "project", "tool", "unit")]
    assert got == [
        ("bare", "Secret Scanner", None), ("bare", "Semgrep", None), ("p", "Bandit", None), ("p", "ESLint", None),
        ("p", "Secret Scanner", None), ("p", "Semgrep", None), ("p", "npm audit", "/srv/p"),
        ("p", "npm audit", "/srv/p/w"), ("p", "pip-audit", None)]
    off = empty.withColumn("skip", F.array(F.lit("dependencies"), F.lit("javascript")))
    left = po.scan_plan(po.effective_policy(off, none), fl.project_languages(inv), fl.npm_project_dirs(inv))
    assert {g["tool"] for g in dicts(left.filter("project = 'p'"))} == {"Bandit", "Secret Scanner", "Semgrep"}


def test_severity_strips_all_white_space(spark):
    words = [" Critical ", "\tWARN\x0b", "  ", "info\n", "Informational", "MODERATE", "odd one"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r.s for r in df.select("i", normalize_severity(F.col("w")).alias("s")).orderBy("i").collect()]
    assert got == ["critical", "medium", "", "low", "low", "medium", "odd one"]
