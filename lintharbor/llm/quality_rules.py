"""Quality rules with thresholds taken from the documents themselves.

A fixed base rule refuses what is too short or mostly repetition. Every other cut-off adapts: KLL
sketches of each measure are gathered per language and source, merged upwards where a group is
small, and the far-out fences of the quartiles become the limits of the group. All of it is built-in
functions; documents never leave their row, only sketches are shuffled.

Defined results: NULL text counts as no words (base rule fails). NULL language or source is a group
of its own. Repeated rows are judged alike. An empty table gives an empty result. Very long texts are
measured whole, in one row. Further columns are kept by `judge` whatever their names, except that those
named in `OUTPUT` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_sized, stored, words, written

OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
WINDOW = 8
SYMBOLS = r"#*$%&|<>"
#: Smallest distance between the quartiles that a fence is built on, so that uniform groups keep their rows.
LEAST_SPREAD = {"symbol_share": 0.02, "dup_line_share": 0.1, "repeat_share": 0.05, "word_length": 1.0}
#: Measures that can also be too low.
TWO_SIDED = ("word_length",)


def repeat_words(w: Column) -> Column:
    """Words in windows of `WINDOW` words that occur at least twice in the array of hashes `w`.

    `w` stays an array of longs: elements are read by position, because slicing copies the array.
    """
    n = F.size(w) - WINDOW + 1
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))


def covered(windows: Column) -> Column:
    """Positions covered by the windows whose hash is not unique. Evaluated only where there are any."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        return F.filter(sorted_pairs, lambda x, k: (
            F.get(sorted_pairs, k - 1)["h"].eqNullSafe(x["h"]) | F.get(sorted_pairs, k + 1)["h"].eqNullSafe(x["h"])))

    # A one-element array binds the sorted pairs to a variable, so that they are sorted once.
    places = F.transform(F.array(pairs), lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))[0]
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base counts of each whole text and the shares the fences are built on."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("_w")
    kept = [c for c in docs.columns if c not in [*OUTPUT, "n_lines"]]
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"), covered(F.col("_win"))).otherwise(F.lit(0)),
    }
    # The generator keeps filters on the counts above it: pushed below, they would be evaluated
    # inside the lambdas, once for each word.
    return (
        docs.select(*kept)
        .withColumns({"_w": words(F.col(text)), "_lines": lines})
        .withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("_win", repeat_words(F.col("_h")))
        .select(*kept, F.inline(F.array(F.struct(*[c.cast("bigint").alias(n) for n, c in counts.items()]))))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def shares() -> dict[str, Column]:
    one = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / one,
        "word_length": F.col("word_chars") / one,
    }


def fences(measured: DataFrame, k: int = 1024, least_docs: int = 200, reach: float = 3.0) -> DataFrame:
    """One row per (lang, source): the limits of each measure, over all documents that pass the base rule.

    Sketches are aggregated before the shuffle and merged: a group of fewer than `least_docs` documents
    takes the limits of its language, a language as small those of all documents. A sketch of `k`
    answers exactly up to `k` documents, and beyond within about 3 / k of the rank.
    """
    names = list(shares())
    sketched = stored(
        measured.filter(~F.col("base_failed")).select("lang", "source", *[c.alias(n) for n, c in shares().items()])
        .groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(n, F.lit(k)).alias(n) for n in names]))
    merge = [F.kll_merge_agg_double(n).alias(n) for n in names]
    by_lang = sketched.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    overall = sketched.agg(F.sum("n").alias("n"), *merge)

    def limits(name: str) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(name, F.lit(q)) for q in (0.25, 0.75))
        spread = F.greatest(high - low, F.lit(LEAST_SPREAD[name]))
        return F.struct((low - reach * spread if name in TWO_SIDED else F.lit(None).cast("double")).alias("low"),
                        (high + reach * spread).alias("high")).alias(name)

    def cut(level: DataFrame, keys: list[str], out: str) -> DataFrame:
        return level.filter(F.col("n") > 0).select(*keys, F.struct("n", *[limits(n) for n in names]).alias(out))

    group, lang, every = cut(sketched, ["lang", "source"], "g"), cut(by_lang, ["lang"], "l"), cut(overall, [], "o")
    lang = lang.withColumnRenamed("lang", "_lang")
    # `every` is one row of an aggregate without keys.
    joined = group.join(lang, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").join(F.broadcast(every))
    chosen = F.when(F.col("g.n") >= least_docs, F.col("g")).when(F.col("l.n") >= least_docs, F.col("l")).otherwise(F.col("o"))
    return stored(joined.select("lang", "source", chosen.alias("limits")))


def judge(docs: DataFrame, text: str = "text", broadcast_groups: int = 50_000, keep: Sequence[str] | None = None,
          **options) -> DataFrame:
    """`docs`, or of it the columns of `keep`, with the counts, `base_failed`, `kept` and the array `failed_rules`.

    Texts are measured once: the counts are written to the shared folder with the columns kept, and both
    the limits and the verdicts read them from there. The table of limits has one row per language and
    source; it is broadcast up to `broadcast_groups` rows and joined by shuffle beyond.
    """
    passed = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUT]

    def group(name: str) -> Column:
        return F.col(name) if name in docs.columns else F.lit(None).cast("string")

    # All columns go by names of our own, so that none can clash.
    base = docs.select(F.col(f"`{text}`").alias("_text"), group("lang").alias("lang"), group("source").alias("source"),
                       *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(passed)])
    measured = written(measure(base, "_text").drop("_text"), "quality-counts")
    limits = fences(measured, **options).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    on = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    failed = [
        F.when((value > F.col(f"limits.{name}.high")) | F.coalesce(value < F.col(f"limits.{name}.low"), F.lit(False)), F.lit(name))
        for name, value in shares().items()]
    out = join_sized(measured, limits, on, "left", broadcast_groups).withColumn(
        "failed_rules", F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *failed)))
    counts = [c for c in OUTPUT if c not in ("kept", "failed_rules")]
    return out.select(*[F.col(f"_p{i}").alias(c) for i, c in enumerate(passed)], *counts,
                      (F.size("failed_rules") == 0).alias("kept"), "failed_rules")
