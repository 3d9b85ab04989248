"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Similarity of a short item to a long document is near zero however fully it is contained, so documents
are partitioned by their number of distinct shingles, and the signature of a partition has as many
bins as its documents need: one hash per shingle, its leading bits choose the bin, and the least hash
of each bin is kept (one-permutation MinHash). With at least `BINS` bins a shingle, a shingle that both
sides share is the least of its bin on the document's side with probability 0.88 or more. An item is a
candidate where any bin agrees; it is missed if all its shared shingles are hidden, at most
0.115 ** (0.8 q) for q shingles. Items with fewer than `SHORT` shingles, where that is not negligible,
are looked up by whole sets instead. Candidates are verified by exact containment.

The sorted array of hashes keeps all of this inside the row: bins are neighbours, and nothing but
signatures that meet an item is shuffled. Only built-in functions are used.

Defined results: texts are lower-cased; fewer than five words make one shingle; NULL and empty texts
match nothing. Rows of `docs` or `items` without an id are not reported. Repeated rows give one pair.
Empty tables give no pairs. Other columns are ignored by `matches` and kept by `without_matches`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, row_key, small, stored, words

SIZE, BINS, SHORT = 5, 4, 8
_BROADCAST_ROWS = 500_000


def with_shingles(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted array of distinct 64-bit shingle hashes of `text`."""
    h, n = F.col("_h"), F.size("_h")
    rolled = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SIZE)]))
    one = F.transform(F.array(F.lit(0)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SIZE - 1)]))
    made = F.sort_array(F.array_distinct(
        F.when(n >= SIZE, rolled).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))))
    kept = [c for c in rows.columns if c != out]
    # The generator keeps filters on the result above it: pushed below, they would evaluate `_h` in the lambdas.
    return (
        rows.select(*kept).withColumn("_h", F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))
        .select(*kept, F.inline(F.array(F.struct(made.alias(out))))))


def size_class(n: Column) -> Column:
    """Number of bits of the bins for sets of n shingles: documents of one partition have it in common."""
    return F.ceil(F.log2(n * BINS)).cast("int")


def minima(hashes: Column, bits: Column) -> Column:
    """The least hash of each bin, from sorted hashes whose leading `bits` bits are the bin."""
    def bin_of(x: Column) -> Column:
        return F.call_function("shiftright", x, 64 - bits)

    return F.filter(hashes, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(hashes, i - 1))))


def _candidates(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(doc_id, item_id) whose signatures agree in a bin of the document's partition."""
    # One signature per item and partition, of which there are 62 at most.
    slots = stored(
        items.filter(F.size("item_set") >= SHORT)
        .select("item_id", "item_set", F.explode(F.sequence(F.lit(2), F.lit(63))).alias("bits"))
        .select("item_id", "bits", F.explode(minima(F.col("item_set"), F.col("bits"))).alias("least")))
    sets = with_shingles(docs.select("doc_id", text), text, "doc_set")
    signed = (
        sets.select("doc_id", "doc_set", size_class(F.size("doc_set")).alias("bits"))
        .select("doc_id", "bits", F.explode(minima(F.col("doc_set"), F.col("bits"))).alias("least")))
    found = join_sized(signed, slots, ["bits", "least"], "inner", _BROADCAST_ROWS).select("doc_id", "item_id")
    brief = stored(items.filter((F.size("item_set") > 0) & (F.size("item_set") < SHORT))
                   .select("item_id", F.explode("item_set").alias("least")))
    if not small(brief, 0):
        each = sets.select("doc_id", F.explode("doc_set").alias("least"))
        found = found.union(join_sized(each, brief, ["least"], "inner", _BROADCAST_ROWS).select("doc_id", "item_id"))
    return found.distinct()


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): items of which a document holds `percent` of the shingles."""
    items = stored(with_shingles(
        benchmark.filter(F.col("item_id").isNotNull()).select("item_id", F.col("text").alias("_item")), "_item", "item_set"
    ).select("item_id", "item_set").distinct())
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text)
    pairs = stored(_candidates(named, items, text))
    ids = stored(pairs.select("doc_id").distinct())
    sets = with_shingles(join_sized(named, ids, ["doc_id"], "left_semi", _BROADCAST_ROWS), text, "doc_set")
    both = join_sized(sets.select("doc_id", "doc_set"), pairs, ["doc_id"], "inner", _BROADCAST_ROWS)
    compared = join_sized(both, items, ["item_id"], "inner", _BROADCAST_ROWS).select(
        "doc_id", "item_id", F.size("item_set").cast("bigint").alias("n_item"),
        F.size(F.array_intersect("item_set", "doc_set")).cast("bigint").alias("n_shared"))
    # Rows with the same doc_id count by the one that holds most.
    return (compared.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
            .filter(100 * F.col("n_shared") >= percent * F.col("n_item")))


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 80) -> DataFrame:
    """Rows of `docs` that hold no benchmark item.

    Each row is judged by its own text: rows without an id go if they hold an item, and of rows with the
    same id only those that do.
    """
    key = row_key(F.col("doc_id"), F.col(text))
    hit = matches(docs.select(key.alias("doc_id"), text), benchmark, text, percent)
    hit = stored(hit.select(F.col("doc_id").alias("_hit_key")).distinct())
    return join_sized(docs, hit, key == F.col("_hit_key"), "left_anti", _BROADCAST_ROWS)
