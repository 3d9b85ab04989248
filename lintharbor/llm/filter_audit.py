"""Filter interaction audit: what each filter removes, in every order of the filters.

Each row gets a mask of the filters it fails; counts of masks per part are all that the 120 orders need.
Four filters look at one text. The fifth, an equal text with a smaller doc_id, uses radix tries:

- Map tasks insert whole texts into a compressed trie, a window at a time, and pass on one row for each
  distinct text with its least id. Rows with a larger id fail there and then and carry no text further.
- The rest is range-partitioned by text prefixes. A prefix with more than `limit` bytes of texts is made
  longer, past all its texts have in common; if they have all in common, they are one text, and its
  least id is known from the same aggregate. So no trie outgrows `limit` bytes, however many copies or
  texts with a common beginning there are.
- A task builds one trie a prefix, with the least id at each terminal, and flags rows while walking it.

Defined results: a NULL text is empty. A row with a NULL doc_id never has a smaller id, nor is one.
Equal doc_ids with equal texts do not fail each other. `labels` rows with a repeated doc_id count if any
says so; labels without a document, NULL ids and NULL labels count nothing. A NULL part is the empty
string. An empty table gives no parts and so no rows. Further columns are ignored, whatever their names.
Texts are taken whole, word sets of very long ones are gathered in chunks.
"""

from __future__ import annotations

import os.path
import re
import uuid
from collections import Counter
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, shared_dir, small, stored

FILTERS = "ABCDE"
SHORT, UNVARIED, CAPITALS, SYMBOLS, DUPLICATE = (1 << i for i in range(5))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SIGN = re.compile(rb"[#$%&*|]")
_CAPITAL = bytes(range(65, 91))
_CHUNK = 1 << 20
#: Bytes a row takes in a trie beside its text: its own tuples, and the node and terminal of a new text.
_ROW = 256
_TERMINAL = 768
ROWS = "doc_id bigint, part string, mask int, n bigint"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words. `bytes.split` knows exactly the six separators."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        gap = _GAP.search(text, at + _CHUNK)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    return n, len(distinct)


def own_mask(text: bytes, code_points: int) -> int:
    """Bits of the filters that look at one text."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    return (
        SHORT * (n < 200) | UNVARIED * (100 * distinct < 50 * n) | CAPITALS * (100 * capitals > 3 * code_points)
        | SYMBOLS * (_SIGN.search(text) is not None))


class Terminal:
    """End of a text in a trie: the least id, and the rows that have the text."""

    __slots__ = ("least", "rows")

    def __init__(self):
        self.least, self.rows = None, []


class Trie:
    """A compressed trie over bytes: a node is [terminal or None, {first byte: (label, node)}]."""

    def __init__(self):
        self.root = [None, {}]

    def insert(self, text: bytes, doc_id: int, row) -> bool:
        """Whether the text is new."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[1].get(text[at])
            if edge is None:
                child = [None, {}]
                node[1][text[at]] = (text[at:], child)
                node, at = child, len(text)
                break
            label, child = edge
            if not text.startswith(label, at):
                # Split the edge where the text leaves it.
                k = len(os.path.commonprefix([label, text[at: at + len(label)]])) if len(label) < 64 else shared(label, text, at)
                middle = [None, {label[k]: (label[k:], child)}]
                node[1][text[at]] = (label[:k], middle)
                label, child = label[:k], middle
            node, at = child, at + len(label)
        new = node[0] is None
        if new:
            node[0] = Terminal()
        end = node[0]
        end.least = doc_id if end.least is None else min(end.least, doc_id)
        end.rows.append(row)
        return new

    def walk(self):
        """The terminals."""
        return (terminal for terminal, _ in self.spelt())

    def spelt(self):
        """The terminals, each with the labels that lead to it: joined, they are its text."""
        open_nodes = [(self.root, 0, b"")]
        labels = []
        while open_nodes:
            (terminal, edges), depth, label = open_nodes.pop()
            del labels[depth:]
            labels.append(label)
            if terminal is not None:
                yield terminal, labels
            open_nodes.extend((child, depth + 1, label) for label, child in edges.values())


def shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of `label` and `text[at:]`, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low: at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _batches(rows, names, kinds):
    """Rows as batches, none of which is held together with the next. The last column may be a text, in bytes."""
    import pyarrow as pa

    def batch(held):
        columns = list(zip(*held)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += _ROW + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size >= _CHUNK:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _slices(batch, bytes_of: str = "text", rows: int = 256):
    """A batch as few rows at a time, so that no more of them are Python objects; texts are bytes."""
    import pyarrow as pa

    at = batch.schema.get_field_index(bytes_of)
    batch = batch.set_column(at, bytes_of, batch.column(at).cast(pa.binary()))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _local(window_bytes: int):
    """Map stage: masks, and one open row with its text for each distinct text of a window."""
    import pyarrow as pa

    names = ["doc_id", "part", "mask", "n", "open", "bytes", "text"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]

    def closed(trie):
        # The trie itself holds the texts, once each.
        for end, labels in trie.spelt():
            mask, text = end.rows[0][2], None
            for (doc_id, part), n in Counter(row[:2] for row in end.rows).items():
                if doc_id == end.least:
                    text = b"".join(labels) if text is None else text
                    yield doc_id, part, mask, n, True, len(text), text
                else:
                    yield doc_id, part, mask | DUPLICATE, n, False, 0, None

    def run(batches):
        import pyarrow.compute as pc

        trie, held = Trie(), 0
        for batch in batches:
            points = pc.utf8_length(batch.column(2)).to_pylist()
            apart, at = [], 0
            for few in _slices(batch):
                for doc_id, part, raw in zip(*(few.column(i).to_pylist() for i in range(3))):
                    mask = own_mask(raw, points[at])
                    at += 1
                    if doc_id is None:
                        apart.append((None, part, mask, 1, False, 0, None))
                        continue
                    new = trie.insert(raw, doc_id, (doc_id, part, mask))
                    held += _ROW + (len(raw) + _TERMINAL if new else 0)
                if held > window_bytes:
                    yield from _batches(closed(trie), names, kinds)
                    trie, held = Trie(), 0
            yield from _batches(apart, names, kinds)
        yield from _batches(closed(trie), names, kinds)

    return run


def _tries(batches):
    """Reduce stage over rows in order of prefix: one trie a prefix, flags for rows above the least id."""
    import pyarrow as pa

    names = ["doc_id", "part", "mask", "n"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64()]

    def flagged(trie):
        for end in trie.walk():
            for doc_id, part, mask, n in end.rows:
                yield doc_id, part, mask | DUPLICATE * (doc_id > end.least), n

    trie, prefix = Trie(), None
    for batch in batches:
        for few in _slices(batch):
            for key, doc_id, part, mask, n, text in zip(*(few.column(i).to_pylist() for i in range(6))):
                if key != prefix:
                    if prefix is not None:
                        yield from _batches(flagged(trie), names, kinds)
                    trie, prefix = Trie(), key
                trie.insert(text, doc_id, (doc_id, part, mask, n))
    yield from _batches(flagged(trie), names, kinds)


def _common(batches):
    """Characters that the least and the greatest text of a group, and so all of them, have in common."""
    import pyarrow as pa

    for batch in batches:
        least, most = (batch.column(c).to_pylist() for c in ("first", "last"))
        n = [len(os.path.commonprefix(list(pair))) for pair in zip(least, most)]
        same = [a == b for a, b in zip(least, most)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("least"), pa.array(n, pa.int32()), pa.array(same, pa.bool_())],
            ["key", "least", "common", "same"])


def with_prefixes(texts: DataFrame, limit: int, step: int = 16, broadcast_rows: int = 10_000) -> DataFrame:
    """`texts` with `key`, a prefix whose texts take at most `limit` bytes, or `least`, the least id of its text.

    Longer and longer prefixes are read only of the groups that are still too large: past what all their
    texts have in common, by twice as many characters each time.
    """
    rows = texts.withColumns({"key": F.substring("text", 1, step), "least": F.lit(None).cast("bigint")})
    while True:
        sizes = rows.filter("least IS NULL").groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        large = stored(sizes.filter((F.col("bytes") > limit) & (F.col("rows") > 1)).select("key"))
        if small(large, 0):
            return rows
        ends = join_sized(rows.filter("least IS NULL"), large, ["key"], "inner", broadcast_rows).groupBy("key").agg(
            F.min("text").alias("first"), F.max("text").alias("last"), F.min("doc_id").alias("least"))
        spans = stored(ends.mapInArrow(_common, "key string, least bigint, common int, same boolean").select(
            "key", F.when(F.col("same"), F.col("least")).alias("_least"), "common"))
        longer = F.when(
            F.col("common").isNotNull() & F.col("_least").isNull(), F.substring(F.col("text"), F.lit(1), F.col("common") + step))
        rows = join_sized(rows, spans, ["key"], "left", broadcast_rows).withColumns({
            "key": F.coalesce(longer, F.col("key")), "least": F.coalesce("least", "_least")}).drop("_least", "common")
        step *= 2


def fail_masks(docs: DataFrame, part: str = "lang", window_bytes: int = 32 << 20, limit: int = 64 << 20) -> DataFrame:
    """(doc_id, part, mask, n): the filters each document fails, bit i for filter i; `n` rows are alike.

    `window_bytes` bounds the texts a map task holds, `limit` those of one prefix in a reduce task. A
    prefix does not take more than a shuffle partition's share of all texts either.
    """
    folder = f"{shared_dir(docs.sparkSession)}/audit-{uuid.uuid4().hex}"
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"))
    narrow.mapInArrow(_local(window_bytes), f"{ROWS}, open boolean, bytes bigint, text string").write.parquet(folder)
    written = docs.sparkSession.read.parquet(folder)
    total = written.filter("open").agg(F.sum("bytes")).first()[0] or 0
    share = total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    texts = with_prefixes(written.filter("open").select("doc_id", "part", "mask", "n", "text", "bytes"), min(limit, share))
    known = texts.filter("least IS NOT NULL").select(
        "doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")).alias("mask"), "n")
    ranged = (
        texts.filter("least IS NULL").select("key", "doc_id", "part", "mask", "n", "text")
        .repartitionByRange("key").sortWithinPartitions("key"))
    return written.filter("NOT open").select("doc_id", "part", "mask", "n").union(known).union(ranged.mapInArrow(_tries, ROWS))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled so, for each mask that occurs."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Added up before the join, so that an id that repeats is one row a mask; NULL ids join nothing.
    rows = stored(masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))
    joined = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    without = rows.filter("doc_id IS NULL").select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))

    def marked(c: str) -> Column:
        return F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)

    return joined.union(without).groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", **options) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(fail_masks(docs, part, **options), labels)
    # At most 32 masks a part.
    tables = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = (
        tables.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))

    letters = F.split("filter_order", "")
    steps = steps.withColumns({
        "own": bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))),
        "earlier": F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(bit(x)))})
    own, earlier = F.col("own"), F.col("earlier")

    def total(keep, field: str = "n", weigh=lambda x: F.lit(1)) -> Column:
        return F.aggregate("masks", F.lit(0).cast("bigint"), lambda a, x: a + F.when(
            keep(x["mask"]), x[field] * weigh(x["mask"])).otherwise(0))

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) != 0

    def reached(m: Column) -> Column:
        return m.bitwiseAND(earlier) == 0

    # A document counts for a filter in the orders where it comes first among those the document fails.
    n_orders = factorial(len(FILTERS))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total(lambda m: fails(m) & reached(m)).alias("removed"),
        total(lambda m: fails(m) & ~reached(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(lambda m: fails(m) & reached(m), "good").alias("good_lost"),
        total(lambda m: fails(m) & reached(m), "toxic").alias("toxic_lost"),
        total(fails, weigh=lambda m: (F.lit(n_orders) / F.bit_count(m)).cast("int")).alias("shapley"))
