"""Near-duplicate documents by an exact Jaccard join of word shingles under several global orders.

A document is the set of its distinct 5-word shingles (64-bit hashes); documents with equal sets are
one class. Sets of n and m shingles link when their Jaccard similarity reaches `PERCENT` / 100.

1. Loners. If more than n - ceil(0.8 n) shingles of a set occur in no other set, it links with none.
   Counting a fixed range of the hash space proves that for most sets, at a fraction of the shuffle.
2. Of the remaining sets every shingle gets its exact frequency. An order puts rare shingles first
   and breaks ties by a hash of its own, so there are several global orders. Under each one, linked
   sets share a token among their first n - ceil(0.8 n) + 1.
3. Candidates share a prefix token of the first order, at places from which the needed overlap is
   still possible, and then prefix tokens of every other order. Only those are verified.
4. Pairs inside a group are not spelled out. First each posting list is compared with its most
   central member; the links make components. Then only pairs of different components are candidates:
   each list compares the members outside its largest component with all others.

Defined results: lower case for A-Z only; fewer than five words make one shingle; NULL and empty
texts have no shingle, link with nothing and are their own component. Repeated rows are equal texts.
A NULL doc_id is never a component id unless all ids of the component are NULL. An empty table gives
an empty result. Other columns are ignored by `components_of` and kept by `one_per_group`.
Two different sets merge wrongly with the chance of a 64-bit collision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, mix, row_key, shingle_sets, small, stored, text_batches

SIZE, PERCENT, ORDERS = 5, 80, 3
#: Share of the hash space counted to find loners; it must exceed 1 - PERCENT / 100.
SAMPLED = 0.3
_CHUNK = 1 << 20
_BROADCAST_ROWS = 500_000


def _row_chunks(borders: np.ndarray):
    """Ranges of rows of about `_CHUNK` bytes; a longer row is a range of its own."""
    row, n = 0, len(borders) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(borders, borders[row] + _CHUNK, side="right")) - 1)
        yield row, min(last, n)
        row = min(last, n)


def sets_of(column) -> list[np.ndarray]:
    raw, borders = text_batches(column)
    out: list[np.ndarray] = []
    for a, b in _row_chunks(borders):
        out += shingle_sets(raw[borders[a]: borders[b]], borders[a: b + 1] - borders[a], SIZE)
    return out


def signature(shingles: np.ndarray) -> int:
    """Of a set, whatever its order."""
    folded = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([folded], dtype=np.uint64)).view(np.int64)[0])


def _table(batches):
    import pyarrow as pa

    for batch in batches:
        sets = sets_of(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([signature(s) for s in sets], pa.int64())], ["doc_id", "n", "sig"])


def _sampled(batches):
    import pyarrow as pa

    below = np.uint64(int(SAMPLED * 2**64))
    for batch in batches:
        sets = sets_of(batch.column(0))
        parts = [s[: np.searchsorted(s, below)] for s in sets]
        sizes = [len(p) for p in parts]
        tokens = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        sig = np.repeat(np.array([signature(s) for s in sets], dtype=np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(sig)], ["token", "sig"])


def _members(batches):
    import pyarrow as pa

    for batch in batches:
        sets = sets_of(batch.column(0))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([signature(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["sig", "tokens"])


def slack(n: Column) -> Column:
    """Most shingles of a set that a linked set may lack: n - ceil(n * PERCENT / 100)."""
    return n - F.ceil(n * PERCENT / 100).cast("bigint")


def least_overlap(n: Column, m: Column) -> Column:
    """Least size of the intersection of linked sets of n and m shingles."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT)).cast("bigint")


def linked(overlap: Column, n: Column, m: Column) -> Column:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _prefixes(batches):
    """(sig, n, shared tokens with frequency) → number of lone tokens and the prefix under each order."""
    import pyarrow as pa

    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        shared = batch.column(2)
        offsets, flat = shared.offsets.to_numpy(), shared.values
        frequency, token = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        lone, orders = [], [[] for _ in range(ORDERS)]
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            u = int(n[i]) - (b - a)
            room = max(0, int(n[i]) - -(-int(n[i]) * PERCENT // 100) + 1 - u)
            lone.append(u)
            tokens = token[a:b].view(np.uint64)
            for k in range(ORDERS):
                by = mix(tokens + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
                orders[k].append(tokens[np.lexsort((by, frequency[a:b]))[:room]].view(np.int64))
        made = [pa.array(o, pa.list_(pa.int64())) for o in orders]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lone, pa.int64()), *made],
            ["sig", "n", "lone", *(f"p{k}" for k in range(ORDERS))])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        # The least neighbours are stored: the joins can then split a node with very many edges.
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small_star = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))))).select("col.*")
        edges = stored(small_star.filter("a > b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _candidates(left: DataFrame, right: DataFrame, keys: list[str], differ: Column | None = None) -> DataFrame:
    """Pairs (a, b) of posting rows whose lengths and places allow the needed overlap."""
    x, y = left.alias("x"), right.alias("y")
    need = least_overlap(F.col("x.n"), F.col("y.n"))
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    kept = (F.col("x.sig") != F.col("y.sig")) & (F.col("x.n") - F.col("x.at") >= need) & (F.col("y.n") - F.col("y.at") >= need)
    if differ is not None:
        kept &= differ
    for c in on:
        kept &= c
    a, b = F.col("x.sig"), F.col("y.sig")
    return x.join(y, kept).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _verified(pairs: DataFrame, ordered: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs that share prefix tokens under the other orders and are similar enough."""
    rest = [f"p{k}" for k in range(1, ORDERS)]
    x = ordered.select(F.col("sig").alias("a"), F.struct(*rest).alias("_x"))
    y = ordered.select(F.col("sig").alias("b"), F.struct(*rest).alias("_y"))
    filtered = pairs.join(x, "a").join(y, "b")
    for p in rest:
        filtered = filtered.filter(F.arrays_overlap(f"_x.{p}", f"_y.{p}"))
    filtered = stored(filtered.select("a", "b"))
    x = members.select(F.col("sig").alias("a"), F.col("tokens").alias("_x"))
    y = members.select(F.col("sig").alias("b"), F.col("tokens").alias("_y"))
    overlap = F.size(F.array_intersect("_x", "_y"))
    both = filtered.join(x, "a").join(y, "b").filter(linked(overlap, F.size("_x"), F.size("_y")))
    return stored(both.select("a", "b"))


def links(docs: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """Edges between classes (a, b) that join all linked classes into their components."""
    tokens = docs.select(text).mapInArrow(_sampled, "token bigint, sig bigint")
    lone = (tokens.groupBy("token").agg(F.min("sig").alias("sig"), F.max("sig").alias("_other")).filter("sig = _other")
            .groupBy("sig").agg(F.count(F.lit(1)).alias("lone")))
    classes = table.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    left = stored(classes.join(lone, "sig", "left").filter(F.coalesce("lone", F.lit(0)) <= slack(F.col("n"))))
    # Sets of one document of each class that is left. Rows without an id are all looked at.
    ids = stored(left.select("doc_id").distinct())
    own = (join_sized(docs.select("doc_id", text), ids, ["doc_id"], "left_semi", _BROADCAST_ROWS)
           .union(docs.filter(F.col("doc_id").isNull()).select("doc_id", text)))
    members = stored(
        own.select(text).mapInArrow(_members, "sig bigint, tokens array<bigint>").dropDuplicates(["sig"])
        .join(left.select("sig"), "sig", "left_semi"))

    postings = members.select("sig", F.size("tokens").cast("bigint").alias("n"), F.explode("tokens").alias("token"))
    # Stored, so that the join reads both sides from shuffles and can split a hot token.
    frequent = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("frequency")).filter("frequency > 1"))
    shared = (postings.join(frequent, "token").groupBy("sig")
              .agg(F.first("n").alias("n"), F.collect_list(F.struct("frequency", "token")).alias("shared")))
    fields = "sig bigint, n bigint, lone bigint, " + ", ".join(f"p{k} array<bigint>" for k in range(ORDERS))
    ordered = stored(shared.mapInArrow(_prefixes, fields).filter(F.col("lone") <= slack(F.col("n"))))

    lists = stored(ordered.select(
        "sig", "n", "lone", F.posexplode("p0").alias("at", "token")).withColumn("at", F.col("at") + F.col("lone")))
    centre = stored(lists.groupBy("token").agg(F.min(F.struct("lone", "sig", "n", "at")).alias("c")).select("token", "c.*"))
    star = _verified(_candidates(lists, centre, ["token"]), ordered, members)

    roots = connected(star)
    placed = lists.join(roots, F.col("sig") == F.col("node"), "left").select(
        "token", "sig", "n", "at", F.coalesce("root", "sig").alias("root"))
    sizes = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_n"))
    open_lists = sizes.groupBy("token").agg(
        F.count(F.lit(1)).alias("_roots"), F.max(F.struct("_n", "root")).alias("_top")).filter("_roots > 1")
    open_lists = stored(open_lists.select("token", F.col("_top.root").alias("_top")))
    placed = stored(placed.join(open_lists, "token"))
    rest = _verified(
        _candidates(placed.filter("root != _top"), placed, ["token"], F.col("x.root") != F.col("y.root")), ordered, members)
    return star.union(rest)


def components_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row per row of `docs`."""
    table = stored(docs.select("doc_id", text).mapInArrow(_table, "doc_id bigint, n bigint, sig bigint"))
    roots = connected(links(docs, table, text))
    classes = table.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    rooted = classes.join(roots, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig"))
    # Documents alone in their component need no row here. Stored, so that the join can split a hot root.
    lowest = stored(rooted.groupBy("root").agg(
        F.min("class_id").alias("component_id"), F.sum("_n").alias("_all")).filter("_all > 1"))
    named = stored(join_sized(rooted, lowest, ["root"], "inner", _BROADCAST_ROWS).select("sig", "class_id", "component_id"))
    both = table.withColumn("sig", F.when(F.col("n") > 0, F.col("sig")))
    out = join_sized(both, named, ["sig"], "left", _BROADCAST_ROWS)
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("class_id", "doc_id").alias("class_id"))


def one_per_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of `docs` for each component: the one with the least doc_id, then the least key of id and text.

    Each row is placed by its own text, so rows that share a doc_id stay unless they are near-duplicates;
    of rows alike in both, one stays. Rows without a doc_id are kept: nothing names them. Documents without
    words are kept. Where no id repeats, the id is the row's key and nothing else has to be.
    """
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = stored(components_of(docs, text).filter("doc_id != component_id").select("doc_id"))
        return join_sized(docs, gone, ["doc_id"], "left_anti", _BROADCAST_ROWS)
    key = row_key(F.col("doc_id"), F.col(text))
    placed = components_of(docs.select(key.alias("doc_id"), text), text).select(
        F.col("doc_id").alias("_k"), F.col("component_id").alias("_c"))
    ids = docs.select(key.alias("_k"), F.col("doc_id").alias("_id")).groupBy("_k").agg(
        F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_rows"))
    members = stored(placed.distinct().join(ids, "_k"))
    # The least row of a component is found with map-side combine, so a large group is no hot key.
    members = members.filter("_id IS NOT NULL")
    least = stored(members.groupBy("_c").agg(F.min(F.struct("_id", "_k")).alias("_least")).select("_least._k"))
    gone = stored(members.select("_k").join(least, "_k", "left_anti").withColumnRenamed("_k", "_gone"))
    again = stored(members.filter("_rows > 1").select(F.col("_k").alias("_again")))
    kept = join_sized(docs, gone, key == F.col("_gone"), "left_anti", _BROADCAST_ROWS)
    once = join_sized(kept, again, key == F.col("_again"), "left_anti", _BROADCAST_ROWS)
    twice = join_sized(kept, again, key == F.col("_again"), "left_semi", _BROADCAST_ROWS)
    return once.union(twice.dropDuplicates(["doc_id", text]))
