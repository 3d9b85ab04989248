"""Mixing sources to target weights: random order by hash, prefix sums of sizes, a cut at each source's budget.

The size of a document is its number of words. Sources get weights in order of their names, and share
the size of the whole mix by weight; no target exceeds `cap` times what its source has, and what is over
goes to the others by weight. Rows of a source are put in the order of a hash, sorted by ranges of that
hash; running sums within a range and over the ranges before it place the cut. A source whose budget is
beyond its size is taken whole as often as it fits, then up to the cut. The row at the cut is taken in
part, so that a source gives exactly its target rounded to whole words.

Built-in functions only. Texts are read once for their size, and no text is shuffled.

Defined results: NULL and empty texts have size 0 and give nothing. NULL source is a source of its own, and the
last one. Equal rows (doc_id and text) share one place in the order: at the cut each of them gives the
same number of words, so that at most one word fewer than rows is left out. Very long texts count whole. A source
without words has target 0. An empty table gives an empty result. Columns of `docs` that clash with
`OUTPUT` are replaced, other columns stay in `mixture`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, join_sized, stored

OUTPUT = ["doc_id", "source", "size", "source_size", "target", "taken"]
WORD = r"[^\x20\x09-\x0D]+"
#: Exact integer arithmetic whatever the corpus size.
EXACT = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of words: of places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column, text: Column, seed: str) -> Column:
    """32 hexadecimal digits, random for any other seed. The id decides, the text only where ids repeat or are NULL."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target (double) and budget (whole words) from one row (source, source_size) a source.

    With the sources in order of cap over weight, those that reach their cap come first: one does if its
    share of what is left after all before it is at least its cap. All comparisons are between integers.
    """
    common = reduce(lcm, weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_reach = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    after = by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()

    def total(c: str, over) -> Column:
        return F.coalesce(F.sum(F.col(c).cast(EXACT)).over(over), F.lit(0)).cast(EXACT)

    placed = (
        sizes.withColumn("_w", weight.cast("bigint"))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_reach", F.col("_cap").cast(EXACT) * (F.lit(common) / F.col("_w")).cast("int"))
        .withColumns({"_left": total("source_size", whole) - total("_cap", before), "_weights": total("_w", after)})
        .withColumn("_full", F.col("_cap").cast(EXACT) * F.col("_weights") <= F.col("_left") * F.col("_w")))
    # The first source below its cap, which has the largest weight sum, fixes the share of all that follow it.
    share = F.max(F.when(~F.col("_full"), F.struct("_weights", "_left"))).over(whole)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        F.col("_share._left").cast("double") * F.col("_w").cast("double") / F.col("_share._weights").cast("double"))
    return placed.withColumn("_share", share).select(
        "source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("bigint").alias("budget"))


def cuts(keyed: DataFrame, budgets: DataFrame, bucket_rows: int = 1 << 12) -> DataFrame:
    """Per source: `epochs` taken whole, the key `cut` up to which rows are taken once more, and at the cut
    the words `at_cut` that each row there may give.

    `keyed` has source, key, size. Equal keys are added up before they travel. Keys are random, so ranges of
    equal width have about `bucket_rows` keys each, in a hot source as in any other.
    """
    keys = keyed.groupBy("source", "key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    rows = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    sized = budgets.withColumnRenamed("source", "_s").join(
        rows, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", "_rows", "budget", "source_size",
        F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).alias("epochs"))
    sized = stored(sized.withColumn("_rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / bucket_rows)).cast("double")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    spread = (
        join_sized(keys, sized, F.col("source").eqNullSafe(F.col("_s")), "inner", 50_000)
        .withColumn("bucket", F.floor(place * buckets))
        .select("source", "bucket", "key", "w", "n"))

    def running(over) -> Column:
        return F.sum("w").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")

    # Sums within a range need no further shuffle: ranges never split a bucket.
    ranged = stored(spread.repartitionByRange("source", "bucket").withColumn(
        "_in", running(Window.partitionBy("source", "bucket").orderBy("key"))))
    # Sums over the ranges before: one row for each `bucket_rows` keys, in blocks of as many ranges.
    sums = ranged.groupBy("source", "bucket").agg(F.sum("w").alias("w")).withColumn("block", F.floor(F.col("bucket") / bucket_rows))
    blocks = sums.groupBy("source", "block").agg(F.sum("w").alias("w"))
    blocks = blocks.select("source", "block", running(Window.partitionBy("source").orderBy("block")).alias("_base"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("source", "block")]
    starts = stored(
        sums.withColumn("_inner", running(Window.partitionBy("source", "block").orderBy("bucket"))).alias("x")
        .join(blocks.alias("y"), same)
        .select(F.col("x.source").alias("_ss"), F.col("x.bucket").alias("_b"), (F.col("_inner") + F.col("_base")).alias("_start")))

    placed = join_sized(
        ranged, starts, F.col("source").eqNullSafe(F.col("_ss")) & (F.col("bucket") == F.col("_b")), "inner", 50_000,
    ).select("source", "key", "w", "n", (F.col("_start") + F.col("_in")).alias("before"))
    # One row a source: the key in which the budget ends.
    ends = join_sized(placed, sized, F.col("source").eqNullSafe(F.col("_s")), "inner", 50_000).filter(
        (F.col("before") < F.col("_rest")) & (F.col("_rest") <= F.col("before") + F.col("w")))
    last = ends.select(F.col("_s").alias("_e"), F.col("key").alias("cut"), F.expr("(_rest - before) div n").alias("at_cut"))
    return sized.join(last, F.col("_s").eqNullSafe(F.col("_e")), "left").select(
        F.col("_s").alias("source"), "epochs", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("at_cut", F.lit(0)).alias("at_cut"))


def taken_words() -> Column:
    once_more = F.when(F.col("key") < F.col("cut"), F.col("size")).when(
        F.col("key") == F.col("cut"), F.least("size", "at_cut")).otherwise(0)
    return F.col("epochs") * F.col("size") + once_more


def _plan(docs: DataFrame, weights: Sequence[int], cap: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, key, size) and one row a source: its size, target, epochs and cut."""
    keyed = stored(docs.select(
        "doc_id", "source", order_key(F.col("doc_id"), F.col("text"), seed).alias("key"), n_words(F.col("text")).alias("size")))
    budgets = stored(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    ends = cuts(keyed, budgets).withColumnRenamed("source", "_e")
    per_source = budgets.withColumnRenamed("source", "_s").join(ends, F.col("_s").eqNullSafe(F.col("_e"))).drop("_e", "budget")
    return keyed, stored(per_source)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", sources: int = 50_000) -> DataFrame:
    """doc_id, source, size, source_size, target and the words `taken` of each document.

    The table of sources is broadcast up to `sources` rows and joined by shuffle beyond.
    """
    keyed, per_source = _plan(docs, weights, cap, seed)
    joined = join_sized(keyed, per_source, F.col("source").eqNullSafe(F.col("_s")), "inner", sources)
    return joined.withColumn("taken", taken_words()).select(*OUTPUT)


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", sources: int = 50_000) -> DataFrame:
    """The mix itself: the rows of `docs` once for each epoch that takes them, with `epoch` (from 0) and `size`.

    The text of a row at the cut is its words up to the last one taken, with a space between them.
    Texts stay where they are: each row compares its key with the cut of its source.
    """
    clash = {"epoch", "size"}
    kept = [c for c in docs.columns if c not in clash]
    _, per_source = _plan(docs, weights, cap, seed)
    per_source = per_source.select("_s", F.struct("epochs", "cut", "at_cut").alias("_mix_plan"))
    # `_row` holds the columns of `docs`, so none can clash. The generator keeps the words from being counted
    # anew in every expression that uses their number.
    own = F.struct(order_key(F.col("doc_id"), F.col("text"), seed).alias("_key"), n_words(F.col("text")).alias("_size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.inline(F.array(own)))
    joined = join_sized(rows, per_source, F.col("_row.source").eqNullSafe(F.col("_s")), "inner", sources)
    size, plan = F.col("_size"), F.col("_mix_plan")
    rest = F.when(F.col("_key") < plan["cut"], size).when(
        F.col("_key") == plan["cut"], F.least(size, plan["at_cut"])).otherwise(0)
    whole = F.when(size > 0, plan["epochs"]).otherwise(0)
    epochs = whole + F.when(rest > 0, 1).otherwise(0)
    out = joined.withColumn("_rest", rest).filter(epochs > 0).withColumn(
        "_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs - 1)))
    used = F.when(F.col("_epoch") < plan["epochs"], size).otherwise(F.col("_rest"))
    cut = F.array_join(F.slice(F.split(F.regexp_replace("_row.text", f"^{SPACE}+", ""), f"{SPACE}+"), F.lit(1), used.cast("int")), " ")
    return out.select(
        *[F.when(used < size, cut).otherwise(F.col("_row.text")).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in kept],
        F.col("_epoch").cast("int").alias("epoch"), used.alias("size"))
