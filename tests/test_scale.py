import random

from helpers import dicts
from pyspark.sql import functions as F

from lintharbor.functions import scale


def test_numbering_matches_a_plain_sort(spark):
    rnd = random.Random(7)
    rows, seen = [], set()
    for _ in range(600):
        group, lead = rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.randrange(3)
        seq = rnd.choice([rnd.randrange(40), rnd.randrange(3000), rnd.randrange(2**40), 2**62 + rnd.randrange(99)])
        if (group, seq) not in seen:
            seen.add((group, seq))
            rows.append((group, lead, seq))
    df = spark.createDataFrame(rows, "g string, lead int, seq bigint").repartition(5)

    def expected(key):
        out = {}
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=key)
            out.update({(r[0], r[2]): i + 1 for i, r in enumerate(mine)})
        return out

    for bits in (2, 5, 20):
        plain = scale.number_rows(df, ["g"], digit_bits=bits)
        assert {(r.g, r.seq): r.rn for r in plain.collect()} == expected(lambda r: r[2])
        led = scale.number_rows(df, ["g"], lead=["lead"], digit_bits=bits)
        assert {(r.g, r.seq): r.rn for r in led.collect()} == expected(lambda r: (r[1], r[2]))


def test_block_counts_are_computed_once(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("seq"))
    out = scale.number_rows(df, ["g"], digit_bits=4)
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_project_joins_with_and_without_broadcast(spark):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("project"),
        F.col("id").alias("seq"))
    dim = spark.createDataFrame([("hot", 1), ("p0", 2), ("p3", 3)], "project string, v int")
    plain = {h: sorted(map(tuple, facts.join(dim, "project", h).collect()), key=str)
             for h in ("left", "inner", "left_semi", "left_anti")}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            for how, want in plain.items():
                got = scale.join_per_project(facts, dim, ["project"], how, spread_by=["seq"])
                assert sorted(map(tuple, got.collect()), key=str) == want
        spread = facts.select(F.pmod(F.xxhash64("seq"), F.lit(16)).alias("s")).distinct().count()
        assert spread == 16
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stored_cuts_the_lineage(spark):
    df = scale.stored(spark.range(10).withColumn("x", F.col("id") * 2))
    assert [r["x"] for r in dicts(df, "id")] == list(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
