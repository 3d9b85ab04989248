"""Sets of file paths as exact bitmaps over numbered paths.

A dictionary gives each distinct path of a project a number. From then on a set of paths is a bitmap of 4 KB
for each 32,768 numbers it touches. Sets of runs merge into sets of scans, and those into sets of
projects, by `or`: no path text is shuffled again, and counts of unions are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintharbor.functions.scale import dense_numbers, stored


def dictionary(paths: DataFrame) -> DataFrame:
    """(project, path, no): numbers from 1 for the distinct paths of each project."""
    distinct = paths.select("project", "path").filter("path IS NOT NULL").distinct()
    return dense_numbers(distinct, ["project"], ["path"], "no").withColumn("no", F.col("no") + 1)


def bitmaps(paths: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, bucket, bits) from rows (keys…, path); `keys` start with project. Repeats set the same bit."""
    joined = paths.filter("path IS NOT NULL").join(numbers, ["project", "path"])
    return joined.groupBy(*keys, F.bitmap_bucket_number("no").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))


def merge(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of all sets that agree in `keys`."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, keys: Sequence[str], out: str = "n_files") -> DataFrame:
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(out))


def file_counts(paths: DataFrame) -> DataFrame:
    """(project, scan_id, run_no, n_files): distinct files of each run, of each scan over its configurations
    (run_no NULL), and of each project over its scans (scan_id NULL), from one reading of the paths."""
    runs = stored(bitmaps(paths, dictionary(paths), ["project", "scan_id", "run_no"]))
    scans = merge(runs, ["project", "scan_id"])
    projects = merge(scans, ["project"])

    def counted(sets: DataFrame, keys: list[str]) -> DataFrame:
        rows = sizes(sets, keys)
        return rows.select(
            "project", (F.col("scan_id") if "scan_id" in keys else F.lit(None).cast("string")).alias("scan_id"),
            (F.col("run_no") if "run_no" in keys else F.lit(None).cast("bigint")).alias("run_no"), "n_files")

    return counted(runs, ["project", "scan_id", "run_no"]).union(counted(scans, ["project", "scan_id"])).union(
        counted(projects, ["project"]))
