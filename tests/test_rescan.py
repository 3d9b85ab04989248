"""Trigram index and path bitmaps."""

import random

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from lintharbor import rules
from lintharbor.operators import detect as dt
from lintharbor.operators import path_sets as ps
from lintharbor.operators import rescan
from lintharbor.rules import Rule
from lintharbor.sources import files as fl
from lintharbor.sources.walk import walk
from lintharbor.workload import fixtures as fx

HITS = ["project", "path", "line", "rule_id"]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return fx.sources(spark, sf).select("project", "path", "language", "text").cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index"))
    rescan.build_index(corpus, out)
    return out


def hits(df):
    return sorted(tuple(r) for r in df.select(*HITS).collect())


@pytest.mark.parametrize("rule", rules.CODE_RULES, ids=lambda r: r.rule_id)
def test_each_rule_finds_what_a_full_scan_finds(spark, corpus, index, rule):
    allowed = rescan.candidate_files(spark, index, [rule])
    again = rescan.rescan(corpus, index, [rule], dt.vulnerable_pattern_scan)
    assert hits(again) == hits(dt.vulnerable_pattern_scan(corpus, [rule]))
    if rescan.indexable(rule):
        holding = {(r.project, r.path) for r in corpus.collect() if any(k in r.text for k in rule.keywords)}
        found = {tuple(r) for r in allowed.collect()}
        assert holding <= found and len(found) < corpus.count() / 2
    else:
        assert allowed.count() == corpus.select("project", "path").distinct().count()


def test_secrets_and_mixed_rules(spark, index, corpus):
    assert not rescan.indexable(Rule("X", "t", "f", "A03", "low", "x+", ("python",)))
    assert not rescan.indexable(next(r for r in rules.CODE_RULES if r.rule_id == "SQL03"))
    again = rescan.rescan(corpus, index, rules.CODE_RULES, dt.vulnerable_pattern_scan)
    assert hits(again) == hits(dt.vulnerable_pattern_scan(corpus))
    changed = Rule("RND02", "t", "Insecure random", "A02", "low", "nonce", ("javascript", "typescript"), ("nonce",))
    full = dt.vulnerable_pattern_scan(corpus, [*[r for r in rules.CODE_RULES if r.rule_id != "RND02"], changed])
    former = dt.vulnerable_pattern_scan(corpus)
    assert hits(rescan.replace_rules(former, rescan.rescan(corpus, index, [changed], dt.vulnerable_pattern_scan), [changed])) == hits(full)


def test_only_candidate_files_are_opened(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n" + ("table = pickle.load(f)\n" if i % 10 == 3 else "é\U0001F600 pick le.load\n"))
    (tmp_path / "short.py").write_text("ab")
    (tmp_path / "empty.py").write_text("")
    rescan.build_index(fl.read_text_files(spark, str(tmp_path), "p"), f"{tmp_path}/.index")
    for i in range(30):
        if i % 10 != 3:
            (tmp_path / f"f{i}.py").chmod(0)
            (tmp_path / f"f{i}.py").rename(tmp_path / f"gone{i}.py")  # opening it would fail
    roots = spark.createDataFrame([("p", str(tmp_path))], "project string, root string")
    files = walk(roots, skip=[".index"]).withColumn("language", fl.language_of(F.col("path")))
    rule = next(r for r in rules.CODE_RULES if r.rule_id == "DES01")
    got = rescan.rescan(files, f"{tmp_path}/.index", [rule], dt.vulnerable_pattern_scan)
    assert sorted((r["path"].rsplit("/", 1)[-1], r["line"]) for r in dicts(got)) == [("f13.py", 2), ("f23.py", 2), ("f3.py", 2)]


def test_index_is_read_in_part(spark, index):
    found = rescan.candidates(spark, index, [r for r in rules.CODE_RULES if rescan.indexable(r)])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in text or "In(trigram" in text
    assert "BroadcastHashJoin" in text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_as_long_as_the_corpus_are_never_broadcast(spark, corpus, index, monkeypatch):
    files = spark.read.parquet(f"{index}/files")
    assert "Broadcast" not in plan_of(rescan.trigram_rows(corpus, files))
    rows = [("p", None, "abcd"), ("p", None, "cdx"), (None, None, "ab"), (None, "q", "abcabc")]
    texts = spark.createDataFrame(rows, "project string, path string, text string")
    numbers = spark.createDataFrame([("p", None, 0), (None, None, 1), (None, "q", 2)], "project string, path string, file_no bigint")
    assert sorted(tuple(r) for r in rescan.trigram_rows(texts, numbers).collect()) == [
        ("abc", 0), ("abc", 2), ("bca", 2), ("bcd", 0), ("cab", 2), ("cdx", 0)]
    rule = next(r for r in rules.CODE_RULES if rescan.indexable(r))
    wide = next(r for r in rules.CODE_RULES if not rescan.indexable(r))
    monkeypatch.setattr(rescan, "FEW_FILES", 0)
    again = rescan.rescan(corpus, index, [rule, wide], dt.vulnerable_pattern_scan)
    assert "Broadcast" not in plan_of(again)
    assert hits(again) == hits(dt.vulnerable_pattern_scan(corpus, [rule, wide]))


def test_bitmaps_count_as_distinct_does(spark):
    r = random.Random(2)
    rows = [(r.choice("pq"), f"s{r.randint(0, 3)}", r.randint(0, 5), f"/f{r.randint(0, 400)}") for _ in range(5000)]
    rows += [("big", "s", 0, f"/n{i}") for i in range(70_000)] + [("p", "s0", 1, None)]
    df = spark.createDataFrame(rows, "project string, scan_id string, run_no bigint, path string")
    got = {(x.project, x.scan_id, x.run_no): x.n_files for x in ps.file_counts(df).collect()}
    want = {}
    for p, s, n, path in rows:
        for key in ((p, s, n), (p, s, None), (p, None, None)):
            want.setdefault(key, set()).update([path] if path else [])
    assert got == {k: len(v) for k, v in want.items() if v}
    text = ps.merge(ps.bitmaps(df, ps.dictionary(df), ["project", "scan_id", "run_no"]), ["project"])._jdf.queryExecution().executedPlan().toString()
    last = text.split("Exchange hashpartitioning")[1].split("\n")[1]
    assert "path" not in last
