"""Timed runs of the workload: the same rows as a join of rendered reports, without shuffling these."""

from datetime import datetime

from pyspark.sql import functions as F

from lintharbor.workload import fixtures as fx


def test_reports_are_rendered_behind_the_join(spark, tmp_path):
    rows = [(i, i % 7, datetime(2024, 1, 10 + i % 9, i % 24, 5), "click", float(i)) for i in range(60)]
    rows += [(4, 1, datetime(2024, 1, 20, 3, 1), "view", 2.5), (4, 1, datetime(2024, 1, 20, 3, 1), "view", 2.5),
             (None, 2, datetime(2024, 1, 2), "view", 1.0), (200, None, None, None, None)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double").write.parquet(
        f"{tmp_path}/events.parquet")
    got = fx.timed_runs(spark, str(tmp_path))
    began = fx.events(spark, str(tmp_path)).selectExpr(
        "event_id as run_no", "cast(date_trunc('hour', ts) as timestamp) as started_at")
    want = fx.scan_runs(spark, str(tmp_path)).join(began, "run_no").withColumn(
        "ended_at", F.col("started_at") + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)")))
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == 59 + 9 + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "stdout" not in plan.split("SortMergeJoin")[-1]
