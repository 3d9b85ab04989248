"""Numbering and joins that stay bounded per task however the groups are skewed."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    seq: str = "seq",
    out: str = "rn",
    lead: Sequence[str] = (),
    digit_bits: int = 20,
) -> DataFrame:
    """1-based position of each row inside `group`, ordered by (`lead`, `seq`).

    A plain ``row_number() over (partition by group)`` sorts a whole group in one task. Here
    `seq` (non-negative, unique inside a group) is read as digits of `digit_bits` bits. Rows are
    numbered inside one low digit only, and the start of each digit block comes from a small tree
    of counts, three levels for 63 bits. No window partition exceeds 2**digit_bits rows.
    `lead` takes few distinct values (a priority, a severity rank). `group` and `lead` are not NULL.
    """
    keys = [*group, *lead]

    def digit(column: str) -> Column:
        # Never NULL by type, so joins add no filters that would make the equal count subplans
        # below differ; Spark then computes the lowest counts once and reuses the exchange.
        return F.coalesce(F.shiftright(F.col(column), digit_bits), F.lit(-1).cast("bigint"))

    counts = df.groupBy(*keys, digit(seq).alias("_d0")).agg(F.count(F.lit(1)).alias("_n"))
    levels = [counts]
    for depth in (1, 2):
        counts = counts.groupBy(*keys, digit(f"_d{depth - 1}").alias(f"_d{depth}")).agg(
            F.sum("_n").alias("_n"))
        levels.append(counts)

    def starts(level: DataFrame, within: list[str], order: list[str]) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return level.withColumn("_start", F.sum("_n").over(w) - F.col("_n")).drop("_n")

    tree = starts(levels[2], list(group), [*lead, "_d2"])
    for depth in (1, 0):
        child, parent = f"_d{depth}", f"_d{depth + 1}"
        inner = starts(
            levels[depth].withColumn(parent, digit(child)),
            [*keys, parent], [child])
        tree = (
            inner.join(tree.withColumnRenamed("_start", "_base"), [*keys, parent])
            .withColumn("_start", F.col("_start") + F.col("_base"))
            .drop("_base", parent)
        )

    local = Window.partitionBy(*keys, "_d0").orderBy(seq)
    return (
        df.withColumn("_d0", digit(seq))
        .join(tree, [*keys, "_d0"])
        .withColumn(out, F.col("_start") + F.row_number().over(local))
        .drop("_d0", "_start")
    )


def dense_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """`df` with `out`, the position from 0 within `group` by `order`, whatever the types of both.

    Rows are sorted by ranges over all tasks. A position is the place within the task's range plus the
    rows of the group in the ranges before it, of which there are as many as tasks. The sorted rows are
    stored, so that places cannot change. Rows alike in `order` may change places, group columns that
    are NULL are equal.
    """
    keys = [*group, *order]
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    ranges = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.sum("_rows").over(before) - F.col("_rows") - F.col("_first")
    starts = ranges.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), shift.alias("_shift"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return (
        placed.join(starts, [*same, F.col("_range") == F.col("_r")])
        .withColumn(out, F.col("_at") + F.col("_shift"))
        .select(*df.columns, out))


def stored(df: DataFrame) -> DataFrame:
    """A result several jobs or branches read, kept as reliable checkpoint files.

    The folder is the session's `spark.checkpoint.dir`, which all nodes share, or one below the
    warehouse, which they share as well. A private folder is made only where there is but one
    machine, in local mode. A lost executor then costs its own tasks only.
    """
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that `stored` writes to, for tables of other shapes."""
    set_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def set_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.match(r"local(\[[^]]*\])?$", context.master):
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str = "seq", n: int = 1,
                  rank: str | None = None) -> DataFrame:
    """First `n` rows per key. Spark prunes to `n` per key before the shuffle, so hot keys stay small."""
    position = rank or "_rn"
    ranked = df.withColumn(
        position, F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    ).filter(F.col(position) <= n)
    return ranked if rank else ranked.drop(position)


def join_per_project(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    salts: int | None = None,
) -> DataFrame:
    """Join a large table to one with few rows per key, one hot key notwithstanding.

    No broadcast is forced: Spark broadcasts `dim` only while its size is under the session's
    threshold. Beyond that both sides shuffle, and the salt splits a hot key over `salts` tasks:
    the session's `spark.lintharbor.salts`, 16 where it is unset.
    """
    salts = salts or int(facts.sparkSession.conf.get("spark.lintharbor.salts", "16"))
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    return facts.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
