"""Plans are part of the contract: what may shuffle, what is pruned, what never appears."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from __spark_entry__ import queries as all_queries
from lintharbor.operators import detect as dt
from lintharbor.operators import rollup as ru
from lintharbor.sources import report_pass as rpp
from lintharbor.sources import reports as rp
from lintharbor.sources import runs as rn
from lintharbor.workload import fixtures as fx
from lintharbor.workload.oracle import SQL
from lintharbor.workload.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_product_no_single_partition(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|InPandas|InArrow", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|SinglePartition", text)


NARROW = ["read_bandit", "read_semgrep", "successful_scans", "custom_reader", "sarif_results", "union_findings",
          "vulnerable_pattern_scan", "missing_control_scan", "explode_lines", "tool_status", "exit_status",
          "scan_envelope", "effective_policy", "remediation_lookup", "exclude_globs", "file_inventory"]


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_operators_do_not_shuffle(spark, sf, name):
    assert "Exchange hashpartitioning" not in plan(QUERIES[name](spark, sf))


def test_dedup_prunes_before_its_only_shuffle(spark, sf):
    text = plan(ru.dedup_findings(fx.findings(spark, sf)))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")
    assert "fingerprint" in re.search(r"Exchange hashpartitioning\(([^)]*)\)", text).group(1)


def test_counts_are_hash_aggregates_with_partial_steps(spark, sf):
    text = plan(QUERIES["risk_score"](spark, sf))
    assert text.count("HashAggregate") == 4 and "SortAggregate" not in text and "ObjectHash" not in text
    assert text.count("Exchange hashpartitioning") == 2 and text.count("FileScan") == 1


def test_scans_are_pruned_and_filtered(spark, tmp_path, sf):
    fx.scan_runs(spark, sf).write.parquet(f"{tmp_path}/runs")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    text = plan(rp.read_bandit(runs))
    assert "EqualTo(tool,Bandit)" in text and "stderr" not in text
    text = plan(rp.findings_from_runs(runs))
    assert "In(exit_code, [0,1])" in text and text.count("FileScan") == 1 and "file_count" not in text
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("path"), "text", "lang", "n_chars")
    assert "lang" not in plan(dt.secret_detection(docs).select("path", "line")).split("ReadSchema:")[1]


def test_texts_are_filtered_before_they_are_split(spark, sf):
    text = plan(dt.secret_detection(fx.corpus(spark, sf)))
    assert text.index("posexplode") < text.rindex("Filter")


def test_places_of_secrets_are_the_only_shuffle_and_carry_no_text(spark, sf):
    text = plan(dt.secret_detection(fx.corpus(spark, sf)))
    assert text.count("Exchange") == 1
    moved = re.search(r"Exchange hashpartitioning\(_line#\d+L, \d+\), REPARTITION_BY_COL[^\n]*\n[^\n]*Project \[([^]]*)\]", text)
    assert "Exchange hashpartitioning(_line" in text and (moved is None or "content" not in moved.group(1))


def test_reports_are_read_and_parsed_once(spark, tmp_path, sf):
    fx.timed_runs(spark, sf).write.parquet(f"{tmp_path}/runs")
    text = plan(rpp.tagged_rows(spark.read.parquet(f"{tmp_path}/runs")))
    assert text.count("FileScan") == 1 and "Exchange" not in text
    # A parse per tool's shape and one for the totals of the Node audit; paths and errors add none.
    assert text.count("paths, StructField") == 0 and len(re.findall(r"from_json\([^)]*paths", text)) <= 1
    for name in ("exit_status", "tool_status", "scan_envelope", "union_findings"):
        assert plan(QUERIES[name](spark, sf)).count("FileScan") == 1
    # Consumers read the written rows of their kind and no report.
    tagged = rpp.written(rpp.tagged_rows(spark.read.parquet(f"{tmp_path}/runs")))
    for df in (rpp.findings(tagged), rpp.run_rows(tagged), rpp.exit_status(tagged)):
        assert "stdout" not in plan(df) and "PartitionFilters: [isnotnull(kind" in plan(df)


def test_the_pass_agrees_with_the_single_readers(spark, sf):
    runs = fx.scan_runs(spark, sf)
    tagged = rpp.written(rpp.tagged_rows(runs))
    for one, other in ((rpp.findings(tagged), rp.findings_from_runs(runs)), (rpp.exit_status(tagged), rn.exit_status(runs)),
                       (rpp.tool_status(tagged), rn.tool_status(runs))):
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0
    assert rpp.of_kind(tagged, "path").count() == rp.scanned_paths(runs).count()


def test_entry_and_contract(spark):
    first = entry(spark)
    assert first.columns == ["project", "scan_id", "critical_count", "high_count", "medium_count", "low_count",
                             "raw_risk_score", "risk_score", "risk_level"]
    assert first.count() == 924
    assert set(QUERIES) == set(SQL) and len(QUERIES) == 101
    assert set(QUERIES) <= set(all_queries())
