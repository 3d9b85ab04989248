"""Merkle manifest of a dataset: one tree a source, a tree over their roots, and a proof for each row.

Leaves hash all five columns of a row. Per source they are ordered by doc_id; runs of 16 nodes become
their parent until one node, the subroot, is left. The subroots, ordered by source, give the root alike.

Proofs are made as octopus multiproofs. Leaves lie in aligned blocks of `BLOCK`. A block derives every
node above its own leaves, so all it lacks are the siblings on the one path from its top to the root:
it names their coordinates once, fetches them in one join, derives the shared nodes in place, and only
then expands the proof of each leaf. What is fetched for a block is some 15 hashes a level.

Defined results: NULL columns hash as `-`. NULL source is a source of its own and comes first, rows with
a NULL doc_id come first in their source and are never tampered with. Equal doc_ids of a source are
ordered by leaf hash, so repeated rows are neighbours with proofs of their own. Texts are hashed whole,
however long. An empty table gives no rows. Columns beyond the five are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_sized, small, stored

FANOUT = 16
#: Leaves of a block: 16 to the power of `BLOCK_LEVELS`, so that a block's levels are whole subtrees.
BLOCK_LEVELS = 3
BLOCK = FANOUT ** BLOCK_LEVELS
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Name of the tree over the subroots. Trees of sources start with 0 (NULL) or 1.
TOP = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of the columns, each with its length before it."""
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf, and `changed`: the leaf after tampering where `tampered` holds, else NULL.

    Tampering lower-cases the A-Z of the text.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    columns = [F.col(c) for c in COLUMNS]
    altered = [*columns[:-1], F.translate("text", _UPPER, _LOWER)]
    return docs.select(*COLUMNS).select(
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("tree"),
        "doc_id", leaf_hash(columns).alias("leaf"), F.when(tampered, leaf_hash(altered)).alias("changed"))


def numbered(df: DataFrame, group: str, order: list[str], limit: int = 50_000) -> DataFrame:
    """`df` with `idx`, the position from 0 within `group` by `order`, and `n`, the rows of the group.

    Rows are sorted by ranges over all tasks, whatever the share of one group. A position is the place
    within the task's range plus the rows of the group in the ranges before it.
    """
    placed = stored(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    ranges = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = stored(ranges.select(
        group, "_range", (F.sum("_rows").over(before) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n")))
    return join_sized(placed, starts, [group, "_range"], "inner", limit).withColumn(
        "idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _up(n: Column) -> Column:
    return F.floor((n + FANOUT - 1) / FANOUT).cast("bigint")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that have several nodes; `width` is the number of nodes of a level."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    return (
        nodes.filter("width > 1")
        .groupBy("tree", "level", "width", F.floor(F.col("idx") / FANOUT).cast("bigint").alias("parent"))
        .agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("hash"))
        .select("tree", (F.col("level") + 1).alias("level"), F.col("parent").alias("idx"), _up(F.col("width")).alias("width"), "hash"))


def levels_above(nodes: DataFrame, widest: int) -> DataFrame:
    """`nodes` and all levels above them; `widest` is the largest width, so the number of levels is known."""
    every, level = nodes, nodes
    while widest > 1:
        level = parents(level)
        every = every.union(level)
        widest = -(-widest // FANOUT)
    return stored(every)


def depth(width: int) -> int:
    """Levels above `width` nodes until one is left."""
    levels = 0
    while width > 1:
        width, levels = -(-width // FANOUT), levels + 1
    return levels


def climb(positions: dict[int, str], width: int, fetched: dict[int, dict[int, str]]):
    """Derive upwards from known nodes {idx: hash} until one is left.

    Returns that node's hash and, for each level, the members of the runs that were hashed. `fetched`
    holds the missing siblings by level.
    """
    levels: list[dict[int, list[str]]] = []
    while width > 1:
        known = {**fetched.get(len(levels), {}), **positions}
        runs = {
            run: [known[i] for i in range(run * FANOUT, min(run * FANOUT + FANOUT, width))]
            for run in {i // FANOUT for i in positions}}
        positions = {run: _digest("".join(members)) for run, members in runs.items()}
        levels.append(runs)
        width = -(-width // FANOUT)
    return positions[0], levels


def path(i: int, levels: list[dict[int, list[str]]]) -> list[tuple[list[str], list[str]]]:
    """The members left and right of node `i` and of its ancestors, level by level."""
    out = []
    for runs in levels:
        members = runs[i // FANOUT]
        out.append((members[: i % FANOUT], members[i % FANOUT + 1:]))
        i //= FANOUT
    return out


def missing(positions: set[int], width: int):
    """(level, idx) of the siblings that cannot be derived from the nodes at `positions`: the least union."""
    level = 0
    while width > 1:
        runs = {i // FANOUT for i in positions}
        for run in runs:
            for i in range(run * FANOUT, min(run * FANOUT + FANOUT, width)):
                if i not in positions:
                    yield level, i
        positions, width, level = runs, -(-width // FANOUT), level + 1


def _block_top(hashes: list[str], n: int) -> str:
    """The node over a block: at the level of blocks, where lone nodes are hashed too, or the subroot of a small tree."""
    for _ in range(BLOCK_LEVELS if n > BLOCK else depth(n)):
        hashes = [_digest("".join(hashes[i: i + FANOUT])) for i in range(0, len(hashes), FANOUT)]
    return hashes[0]


def _tops(batches):
    import pyarrow as pa

    for batch in batches:
        tops = [_block_top(h, n) for h, n in zip(batch.column("hashes").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), batch.column("n"), pa.array(tops, pa.string())],
            ["tree", "block", "n", "hash"])


def _wanted(batches):
    """Coordinates each block lacks: siblings above it in its own tree, then in the tree over the subroots."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for tree, block, n, place, trees in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "place", "trees"))):
            own = missing({block}, -(-n // BLOCK)) if n > BLOCK else ()
            out += [(tree, block, tree, level + BLOCK_LEVELS, i) for level, i in own]
            out += [(tree, block, TOP, level, i) for level, i in missing({place}, trees)]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "block", "of", "level", "idx"])


def _proofs(block: int, n: int, place: int, trees: int, rows: list[dict], nodes: list[dict]):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified, siblings) of each leaf of a block.

    `rows` are in order of position and fill the block, or what is left for the tree's last one.
    """
    above: dict[int, dict[int, str]] = {}
    own: dict[int, dict[int, str]] = {}
    for x in nodes:
        (above if x["of"] == TOP else own).setdefault(x["level"], {})[x["idx"]] = x["hash"]
    first = block * BLOCK
    subroot, lower = climb({first + i: x["leaf"] for i, x in enumerate(rows)}, n, own)
    root, upper = climb({place: subroot}, trees, above)
    shared = path(place, upper)
    tails: dict[int, list] = {}
    for i, x in enumerate(rows, first):
        run = i // FANOUT
        if run not in tails:
            tails[run] = path(run, lower[1:]) + shared
        steps = path(i, lower[:1]) + tails[run]
        siblings = [h for left, right in steps for h in left + right]
        folded = x["changed"] or x["leaf"]
        for left, right in steps:
            folded = _digest("".join([*left, folded, *right]))
        yield x["doc_id"], x["leaf"], subroot, root, _digest("".join(siblings)), folded, folded == root, siblings


def _expand(batches, fields):
    """A batch of rows a block; `fields` names the columns kept."""
    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "verified": pa.bool_(), "proof": pa.list_(pa.string())}
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    for batch in batches:
        for r in range(batch.num_rows):
            block, n, place, trees, rows, nodes = (
                batch.column(c)[r].as_py() for c in ("block", "n", "place", "trees", "rows", "nodes"))
            columns = dict(zip(names, zip(*_proofs(block, n, place, trees, rows, nodes or []))))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f], kinds.get(f, pa.string())) for f in fields], fields)


def manifest(docs: DataFrame, tampered: Column | None = None, with_proof: bool = False, broadcast_nodes: int = 50_000,
             broadcast_blocks: int = 1_000) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row, and on request the proof.

    `tampered` is a condition on the columns of `docs` (by default a fifth of the ids): those rows are
    folded from the altered leaf, with the siblings of the untampered data. Fetched nodes are broadcast
    up to `broadcast_blocks` blocks (some 10 kB each), the node table up to `broadcast_nodes` rows;
    beyond, both are joined by shuffle, and Spark splits the hot nodes near the root.
    """
    placed = numbered(stored(leaves(docs, tampered)), "tree", ["doc_id", "leaf"])
    rows = F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "changed")))
    blocks = stored(
        placed.groupBy("tree", "n", F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block")).agg(rows.alias("rows")))

    tops = stored(
        blocks.select("tree", "block", "n", F.transform("rows", lambda x: x["leaf"]).alias("hashes"))
        .mapInArrow(_tops, "tree string, block bigint, n bigint, hash string"))
    widest = tops.agg(F.max("n")).first()[0] or 0
    first = tops.filter(F.col("n") > BLOCK).select(
        "tree", F.lit(BLOCK_LEVELS).alias("level"), F.col("block").alias("idx"),
        F.ceil(F.col("n") / BLOCK).cast("bigint").alias("width"), "hash")
    nodes = levels_above(first, -(-widest // BLOCK))
    subroots = tops.filter(F.col("n") <= BLOCK).select("tree", "hash").union(nodes.filter("width = 1").select("tree", "hash"))

    # The tree over the subroots has a leaf a source.
    ranked = stored(numbered(subroots.withColumn("_all", F.lit(TOP)), "_all", ["tree"], broadcast_nodes))
    sources = ranked.select("tree", F.col("idx").alias("place"), F.col("n").alias("trees"))
    trees = ranked.agg(F.max("n")).first()[0] or 0
    upper = levels_above(
        ranked.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "idx", F.col("n").alias("width"), "hash"), trees)

    wanted = join_sized(tops.select("tree", "block", "n"), sources, ["tree"], "inner", broadcast_nodes).mapInArrow(
        _wanted, "tree string, block bigint, of string, level int, idx bigint")
    table = stored(nodes.union(upper).select(F.col("tree").alias("of"), "level", "idx", "hash"))
    fetched = stored(
        join_sized(wanted, table, ["of", "level", "idx"], "inner", broadcast_nodes)
        .groupBy("tree", "block").agg(F.collect_list(F.struct("of", "level", "idx", "hash")).alias("nodes")))
    if small(fetched, broadcast_blocks):
        fetched = F.broadcast(fetched)
    located = join_sized(blocks, sources, ["tree"], "inner", broadcast_nodes).join(fetched, ["tree", "block"], "left")
    schema = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean" + (", proof array<string>" if with_proof else ""))
    fields = [f.split()[0] for f in schema.split(", ")]
    return located.mapInArrow(lambda batches: _expand(batches, fields), schema)
