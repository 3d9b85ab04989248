"""Files as they lie on disk: hidden names, spellings of the root, documents in several files."""

import json
import time

import pytest
from helpers import dicts, findings
from pyspark.sql import functions as F

from lintharbor.operators import detect as dt
from lintharbor.operators.detect import as_findings
from lintharbor.plans import end_to_end as ee
from lintharbor.rules import Rule
from lintharbor.sinks import json_doc
from lintharbor.sinks.pieces import write_documents
from lintharbor.sources import files, saved

TOKEN = 'token = "' + "0123456789abcdef" * 2 + '"\n'
TREE = {
    "__init__.py": TOKEN, "a.py": "x = 1\n", ".env": TOKEN, "node_modules/x/b.py": TOKEN, "requirements.txt": "a\n",
    "svc/requirements.txt": "b\n", "svc/.hidden/c.py": "y = 2\n", "svc/_gen/d.ts": "z\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "build" / "app"
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.mark.parametrize("spelling", ["{}", "{}/", "file:{}", "file://{}"])
def test_all_spellings_of_the_root_list_alike(spark, tree, spelling):
    # Excluded folders are not entered; with none to skip, the inventory marks what lies in them.
    pruned = files.inventory(files.list_files(spark, spelling.format(tree), "p"))
    assert {r["rel_path"] for r in dicts(pruned)} == {n for n in TREE if not n.startswith("node_modules")}
    inv = files.inventory(files.list_files(spark, spelling.format(tree), "p", skip=()))
    got = {r["rel_path"]: r["excluded_dir"] for r in dicts(inv)}
    assert got == {n: n.startswith("node_modules") for n in TREE}
    assert dicts(files.dependency_manifests(inv.filter("not excluded_dir")))[0]["manifests"] == ["requirements.txt"]


@pytest.mark.parametrize("spelling", ["{}", "file://{}"])
def test_detection_reads_hidden_files_and_no_excluded_ones(spark, tree, spelling):
    texts = files.source_texts(files.read_text_files(spark, spelling.format(tree), "p"))
    got = {r["rel_path"] for r in dicts(dt.secret_detection(texts))}
    assert got == {"__init__.py", ".env"}
    globs = spark.createDataFrame([("p", ["*.env"])], "project string, globs array<string>")
    assert {r["rel_path"] for r in dicts(dt.secret_detection(files.source_texts(
        files.read_text_files(spark, spelling.format(tree), "p"), exclude=globs)))} == {"__init__.py"}


def test_excluded_folders_are_never_entered(spark, tmp_path):
    """100,000 files below node_modules: the walk does not even look at the folder."""
    for i in range(100):
        folder = tmp_path / "web" / "node_modules" / f"m{i}"
        folder.mkdir(parents=True)
        for k in range(1000):
            (folder / f"f{k}.js").touch()
    (tmp_path / "web" / "app.js").write_text("run()")
    (tmp_path / "web" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "empty").mkdir()
    start = time.time()
    got = files.list_files(spark, str(tmp_path), "p")
    assert [r["path"] for r in dicts(got)] == [f"{tmp_path}/web/app.js"]
    assert time.time() - start < 20
    (tmp_path / "web" / "node_modules").chmod(0)
    try:
        assert files.list_files(spark, str(tmp_path), "p").count() == 1
    finally:
        (tmp_path / "web" / "node_modules").chmod(0o755)


def test_a_store_that_only_spark_opens(spark, tree):
    """A mount that tasks cannot open: listed level by level, visible files read by Spark."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.code.link./in", f"file://{tree}")
    inv = files.inventory(files.list_files(spark, "viewfs://code/in", "p"))
    assert {r["rel_path"] for r in dicts(inv)} == {n for n in TREE if not n.startswith("node_modules")}
    read = files.source_texts(files.read_text_files(spark, "viewfs://code/in", "p"))
    assert {r["rel_path"]: r["text"] for r in dicts(read)} == {
        n: TREE[n] for n in ("a.py", "requirements.txt", "svc/requirements.txt", "svc/.hidden/c.py", "svc/_gen/d.ts")}


def test_roots_that_are_files_or_missing(spark, tree):
    one = files.inventory(files.list_files(spark, f"file:{tree}/a.py", "p"))
    assert [(r["rel_path"], r["language"]) for r in dicts(one)] == [("a.py", "python")]
    (tree.parent / "package.json").write_text("{}")
    package = files.inventory(files.list_files(spark, f"file:{tree.parent}/package.json", "p"))
    assert [r["language"] for r in dicts(package)] == [None]
    with pytest.raises(Exception, match="nowhere"):
        files.list_files(spark, f"{tree}/nowhere", "p").count()


def test_paths_outside_the_root_keep_their_length(spark):
    df = spark.createDataFrame([("p", "/a/b", "/c/node_modules/d.py")], files.FOUND)
    assert dicts(files.inventory(df))[0]["rel_path"] == "/c/node_modules/d.py"


def test_documents_in_several_files_are_read_whole(spark, tmp_path):
    many = findings(spark, *[{"line": i, "scan_id": f"s{i % 3}", "rule_id": f"R{i}"} for i in range(600)])
    summary = many.select("project", "scan_id").distinct().withColumn("target_path", F.lit("/t"))
    pieces = json_doc.json_document(many, summary, chunk_bits=3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_documents(pieces, str(tmp_path))
        read = saved.read_written_results(spark, str(tmp_path))
        assert {r.doc_id: r["count"] for r in read.groupBy("doc_id").count().collect()} == {"p/s0": 200, "p/s1": 200, "p/s2": 200}
        assert [r.seq for r in read.filter("scan_id = 's1'").orderBy("seq").collect()] == list(range(200))
        broken = spark.createDataFrame([("x", "{"), ("y", None), ("z", "{}"), ("q", "{'a': 1}")], "doc_id string, document string")
        assert sorted(r.doc_id for r in saved.unreadable_documents(broken).collect()) == ["q", "x", "y"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_scans_without_a_target_stay_and_duplicates_stop(spark):
    summary = spark.createDataFrame([("p", "s1"), ("q", "s1")], "project string, scan_id string")
    targets = spark.createDataFrame([("p", "/srv/p", "t", ["Python"])],
                                    "project string, target_path string, timestamp string, languages array<string>")
    got = dicts(ee.report_summary(summary, targets), "project")
    assert [(g["project"], g["target_path"], g["project_name"]) for g in got] == [("p", "/srv/p", "p"), ("q", ".", "")]
    with pytest.raises(ValueError, match="targets"):
        ee.reject_duplicates(targets.union(targets), ee.target_keys(targets), "targets")


def test_numbers_of_own_rules_differ_and_unknown_rules_stop(spark):
    own = [Rule("A", "t", "XSS", "A03", "low", "x", ("python",)), Rule("B", "t", "XSS", "A03", "low", "y", ("python",))]
    hits = spark.createDataFrame(
        [("p", "s", 0, "f", 1, r, "t", "low", "A03", "XSS", "c") for r in ("A", "B")],
        "project string, scan_id string, file_no int, path string, line int, rule_id string, title string, severity string, "
        "owasp string, family string, code string")
    assert len({r.seq for r in as_findings(hits, "Own", own).collect()}) == 2
    with pytest.raises(Exception, match="no number"):
        as_findings(hits, "Own").collect()


@pytest.mark.parametrize("x", [0.35, 1.15, 0.25, 2.675, 12345678.0, 0.0, 0.05, 33.333, 99.95, 1e-9])
def test_one_decimal_rounds_as_python_does(spark, x):
    from lintharbor.functions.text import one_decimal

    assert spark.range(1).select(one_decimal(F.lit(x)).alias("v")).first().v == f"{x:.1f}"


def test_single_quotes_are_no_json(spark):
    from lintharbor.functions.text import is_json

    valid = [
        {"a": "it's"}, {"a": "\"'"}, {"a": "'\""}, [], {"code": "q = \"select '%s'\" % x"}, {"a": "\\", "b": "'"},
        {"a": "\\\"'\\", "b'": ["'", "\n'\t"]}, {"deep": [{"x": "c:\\dir\\", "y": "don't \"quote\""}]}, {"long": "\\'\"" * 50_000}]
    broken = ["{'a': 1}", "{\"a\": 'it\\'s'}", "[\"x\", 'y']", "{\"a\": \"b\\\\\", 'c': 1}", "", "{", "1 2", None]
    rows = [(json.dumps(v), True) for v in valid] + [(b, False) for b in broken]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    assert [r.v for r in df.select(is_json(F.col("t")).alias("v")).collect()] == [r[1] for r in rows]
