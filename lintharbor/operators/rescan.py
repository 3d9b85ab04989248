"""Scanning again after a rule has changed, without reading the corpus.

A corpus is indexed once: the character trigrams of each file, sorted by trigram, so that looking a few
up reads a few row groups. A rule says which words every match contains one of; a file can only match if
all trigrams of one of these words are in it. Rules with a word of less than three characters, or without
words, cannot be narrowed and look at all files. What is found among the candidates is what a full scan
finds, as the rules themselves run on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.functions.scale import dense_numbers, stored
from lintharbor.rules import Rule

FILE_KEYS = ["project", "path"]
#: Trigrams looked up for a word: the rarest ones narrow almost as well as all.
RAREST = 3
#: Most candidate files that are sent to all tasks at once; more are sorted and merged.
FEW_FILES = 10_000


def _same_keys(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}.{k}")) for k in keys])


def trigrams_of(word: str) -> list[str]:
    return sorted({word[i: i + 3] for i in range(len(word) - 2)})


def build_index(texts: DataFrame, out: str, keys: Sequence[str] = FILE_KEYS) -> None:
    """Index (keys…, text) below `out`: `files` numbers them, `trigrams` says which file has which, `counts` how many.

    Texts are read twice and shuffled once, by their keys; then numbers and trigrams are. The files are as many
    as the corpus has, and their table is far larger in memory than on disk, so it is merged and never broadcast.
    Rows with the same keys share a number.
    """
    numbered = dense_numbers(texts.select(*keys).distinct(), [], keys, "file_no")
    numbered.write.parquet(f"{out}/files")
    files = texts.sparkSession.read.parquet(f"{out}/files")
    (trigram_rows(texts, files, keys).repartitionByRange("trigram", "file_no").sortWithinPartitions("trigram", "file_no")
     .write.parquet(f"{out}/trigrams"))
    postings = texts.sparkSession.read.parquet(f"{out}/trigrams")
    (postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("n_files"))
     .repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{out}/counts"))


def trigram_rows(texts: DataFrame, files: DataFrame, keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """(trigram, file_no): the distinct trigrams of each numbered file."""
    known = files.select(F.struct(*keys).alias("_f"), "file_no").hint("merge")
    # One pass of a pattern without width: every position gives the three characters that follow it.
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))
    return texts.select(*keys, "text").join(known, _same_keys(keys, "_f")).select(
        F.explode(found).alias("trigram"), "file_no").distinct()


def indexable(rule: Rule) -> bool:
    return bool(rule.keywords) and all(len(k) >= 3 for k in rule.keywords)


def candidates(spark: SparkSession, index: str, rules: Sequence[Rule]) -> DataFrame:
    """(file_no, rule_id): files that hold all trigrams of a word of the rule. All rules must be indexable.

    The trigrams asked for are as few as the rules' words, so their counts may come to the driver.
    """
    words = sorted({(r.rule_id, k) for r in rules for k in r.keywords})
    asked = sorted({t for _, k in words for t in trigrams_of(k)})
    counts = spark.read.parquet(f"{index}/counts").filter(F.col("trigram").isin(asked))
    rarity = {r.trigram: r.n_files for r in counts.collect()}
    wanted = [(rule, i, t) for i, (rule, k) in enumerate(words)
              for t in sorted(trigrams_of(k), key=lambda t: (rarity.get(t, 0), t))[:RAREST]]
    needed = {i: min(RAREST, len(trigrams_of(k))) for i, (_, k) in enumerate(words)}
    plan = spark.createDataFrame([(*w, needed[w[1]]) for w in wanted], "rule_id string, word int, trigram string, needed int")
    # The list in the filter reaches the scan, where the order of the files lets it skip row groups.
    hits = spark.read.parquet(f"{index}/trigrams").filter(F.col("trigram").isin(sorted({t for _, _, t in wanted})))
    return (
        hits.join(F.broadcast(plan), "trigram").groupBy("file_no", "rule_id", "word", "needed")
        .agg(F.count(F.lit(1)).alias("n")).filter("n = needed").select("file_no", "rule_id").distinct())


def candidate_files(spark: SparkSession, index: str, rules: Sequence[Rule], keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Keys of the files that any of the rules may match."""
    files = spark.read.parquet(f"{index}/files")
    if not all(indexable(r) for r in rules):
        return files.select(*keys)
    found = stored(candidates(spark, index, rules).select("file_no").distinct())
    return files.join(found.hint("merge"), "file_no").select(*keys)


def rescan(texts: DataFrame, index: str, rules: Sequence[Rule], scan: Callable[..., DataFrame],
           keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """`scan(texts, rules)` over the rows of `texts` that the index lets through for these rules.

    `texts` may be the files of `sources.walk.walk`: those that are left are opened, the others are not.
    Rules that cannot be narrowed look at all rows.
    """
    from lintharbor.sources.walk import contents

    spark = texts.sparkSession

    def over(chosen: list[Rule]) -> DataFrame:
        allowed = stored(candidate_files(spark, index, chosen, keys).select(F.struct(*keys).alias("_a")))
        few = allowed.limit(FEW_FILES + 1).count() <= FEW_FILES
        rows = texts.join(allowed.hint("broadcast" if few else "merge"), _same_keys(keys, "_a"), "left_semi")
        return scan(rows if "text" in rows.columns else contents(stored(rows)), chosen)

    narrow, wide = [r for r in rules if indexable(r)], [r for r in rules if not indexable(r)]
    return reduce(DataFrame.unionByName, [over(chosen) for chosen in (narrow, wide) if chosen])


def replace_rules(hits: DataFrame, again: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Former hits with those of the changed rules replaced by what they find now."""
    return hits.filter(~F.col("rule_id").isin(*[r.rule_id for r in rules])).unionByName(again)
