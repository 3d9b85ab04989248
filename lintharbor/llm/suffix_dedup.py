"""Removal of repeated substrings: every byte covered by a `LENGTH`-byte string that starts anywhere else.

1. Anchors. Among the 101 grams of 100 bytes inside a 200-byte window the one with the least hash is
   its anchor. The choice depends on the bytes alone, so equal windows have equal anchors, and a text
   yields about one anchor in 51 bytes. A context is the stretch of all consecutive windows that
   share an anchor.
2. Grams that occur once cannot hold a repeated window. Contexts that are equal as a whole are
   repeated as a whole. Both are settled by counts with map-side combine; only grams that occur
   several times in unequal contexts, at the borders of repeats, are left.
3. Those contexts are dealt by gram and suffix sorted in bounded blocks by two-stage sorting: only
   suffixes smaller than their successor are sorted directly, the others are induced by scanning the
   buckets, and windows whose common prefix with a neighbour reaches 200 bytes are repeated.
   A gram with more than `hot` unequal contexts, as of a passage in a third of all documents, is not
   gathered in a task: its windows are counted one by one, which any number of tasks can share.
4. Spans are merged per row and cut out.

Defined results: NULL text is empty; texts shorter than 200 bytes lose nothing. Rows are told apart by
64 bits of doc_id and text and 16 bits more of the text, so ids may be NULL or repeat; repeated rows
count as each other's copies. An empty table gives an empty result. Very long texts are cut into
stretches for hashing, never shortened. `dedup` keeps further columns whatever their names, except that
those named in `OUTPUT` are replaced. Contexts are compared by 64-bit hashes inside one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _powers, mix, row_key, stored, text_batches

LENGTH, GRAM = 200, 100
SPREAD = LENGTH - GRAM + 1
#: Window starts handled at a time; below 2**20, as positions take 20 bits beside the hash.
CHUNK = 1 << 19
OUTPUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw), _BASE)[:-1], out=total[1:])
    return total, _powers(len(raw), pow(_BASE, -1, 1 << 64))


def hash_of(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def chunks(borders: np.ndarray, reach: int = LENGTH, most: int = CHUNK):
    """(first byte, end byte, rows, borders of their window starts) of runs of rows with at most `most` starts.

    A longer row is cut into stretches of starts; each stretch sees the bytes its last window needs.
    """
    row, n = 0, len(borders) - 1
    while row < n:
        a, b = int(borders[row]), int(borders[row + 1])
        if b - a > most:
            for at in range(a, max(a + 1, b - reach + 1), most):
                yield at, min(b, at + most + reach - 1), np.array([row]), np.array([0, min(most, b - reach + 1 - at)]), at - a
            row += 1
            continue
        last = row
        while last + 1 < n and borders[last + 2] - a <= most:
            last += 1
        yield a, int(borders[last + 1]), np.arange(row, last + 1), borders[row: last + 2] - a, None
        row = last + 1


def contexts(raw: np.ndarray, borders: np.ndarray):
    """Columns (row, start, number of windows, gram hash, context hash), chunk by chunk."""
    for first, end, rows, local, inside in chunks(borders):
        part = raw[first:end]
        if len(part) < LENGTH:
            continue
        total, inverse = prefix_hash(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = hash_of(total, inverse, at, at + GRAM)
        least = (gram & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
        width = 1
        while width * 2 <= SPREAD:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPREAD:
            least = np.minimum(least[: width - SPREAD], least[SPREAD - width:])
        anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        if inside is None:
            of = np.repeat(np.arange(len(rows)), np.diff(local))[: len(anchor)]
            ok = at[: len(anchor)] + LENGTH <= local[of + 1]
            starts, of, begin = at[: len(anchor)][ok], of[ok], local
        else:
            starts = at[: int(local[1])]
            of, begin = np.zeros(len(starts), dtype=np.int64), np.array([-inside])
        if not len(starts):
            continue
        anchor = anchor[starts]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
        count = np.diff(np.concatenate([new, [len(starts)]]))
        start = starts[new]
        yield (rows[of[new]], start - begin[of[new]], count, gram[anchor[new]],
               hash_of(total, inverse, start, start + count + LENGTH - 1))


def _anchored(batches):
    """(doc, text) → one row per context."""
    import pyarrow as pa

    for batch in batches:
        raw, borders = text_batches(batch.column(2))
        doc, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for row, start, count, gram, ctx in contexts(raw, borders):
            place = (start << 24) | (count << 16) | salt[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc[row]), pa.array(place)],
                ["gram", "ctx", "doc", "place"])


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of the suffixes by their first `depth` bytes at least, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # Smaller than the successor: the next different byte is larger. The last byte's run is not.
    change = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.searchsorted(change, np.arange(n))
    known = nearest < len(change)
    follow = change[np.minimum(nearest, max(0, len(change) - 1))] if len(change) else np.zeros(n, np.int64)
    smaller = known & (text[np.minimum(follow + 1, n - 1)] > text)
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    if len(direct):
        windows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
        direct = direct[np.argsort(np.ascontiguousarray(windows).view(f"S{depth}").ravel(), kind="stable")]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, dtype=np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == byte]
        bucket.append(direct[by_byte[byte]: by_byte[byte + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > byte]
        sorted_before = before[np.argsort(text[before], kind="stable")]
        cuts = np.searchsorted(text[sorted_before], np.arange(byte + 1, 257))
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), byte + 1):
            if y > x:
                induced[b].append(sorted_before[x:y])
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether the suffixes at a and b agree on `depth` bytes (a multiple of 8), eight at a time."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype=np.uint64, buffer=padded, strides=(1,))
    same = np.arange(len(a))
    for k in range(0, depth, 8):
        same = same[eight[a[same] + k] == eight[b[same] + k]]
    out = np.zeros(len(a), dtype=bool)
    out[same] = True
    return out


def repeated_starts(block: list[bytes]) -> list[np.ndarray]:
    """For each context the starts of its windows that also start elsewhere in the block."""
    text = np.frombuffer(b"\0".join(block) + b"\0", dtype=np.uint8)
    size = np.array([len(c) for c in block])
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    valid = np.zeros(len(text), dtype=bool)
    for b, n in zip(begin.tolist(), size.tolist()):
        valid[b: b + n - LENGTH + 1] = True
    order = suffix_order(text)
    order = order[valid[order]]
    pair = np.flatnonzero(common_prefixes(text, order[:-1], order[1:]))
    hit = np.zeros(len(text), dtype=bool)
    hit[order[pair]] = True
    hit[order[pair + 1]] = True
    return [np.flatnonzero(hit[b: b + n]) for b, n in zip(begin.tolist(), size.tolist())]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


SPAN = "doc bigint, salt int, first bigint, last bigint"


def _span_batch(rows: list[tuple[int, int, int, int]]):
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "salt", "first", "last"])


def _sorted_blocks(most: int):
    """Contexts in gram order → spans of repeated windows; blocks of at most `most` bytes end between grams."""

    def run(batches):
        block, where, weight, held, last = [], [], [], 0, None

        def spans():
            rows = []
            for (doc, place), n, starts in zip(where, weight, repeated_starts(block)):
                if n == 1 and len(starts):
                    first, final = _runs(starts)
                    at = place >> 24
                    rows += [(doc, place & 0xFFFF, at + a, at + b) for a, b in zip(first.tolist(), final.tolist())]
            return _span_batch(rows)

        for batch in batches:
            for gram, n, doc, place, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held > most and gram != last:
                    yield spans()
                    block, where, weight, held = [], [], [], 0
                block.append(body)
                where.append((doc, place))
                weight.append(n)
                held += len(body)
                last = gram
        if block:
            yield spans()

    return run


def _cut_contexts(batches):
    """(text, asked contexts) → one row per context with its bytes."""
    import pyarrow as pa

    for batch in batches:
        raw, borders = text_batches(batch.column(0))
        asked = batch.column(1)
        flat, lists = asked.flatten(), np.diff(asked.offsets.to_numpy())
        row = np.repeat(np.arange(len(asked)), lists)
        gram, n, doc, place, kinds = (flat.field(i) for i in range(5))
        at = place.to_numpy()
        first = borders[row] + (at >> 24)
        end = first + ((at >> 16) & 0xFF) + LENGTH - 1
        body = [raw[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist())]
        yield pa.RecordBatch.from_arrays(
            [gram, n, doc, place, pa.array(body, pa.binary()), kinds], ["gram", "n", "doc", "place", "body", "kinds"])


def _windows(batches):
    """Contexts of hot grams → one row per window."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            body = np.frombuffer(batch.column(4)[i].as_py(), dtype=np.uint8)
            total, inverse = prefix_hash(body)
            at = np.arange(len(body) - LENGTH + 1)
            whole = hash_of(total, inverse, at, at + LENGTH).view(np.int64)
            fixed = [pa.array(np.full(len(at), batch.column(c)[i].as_py())) for c in (0, 1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(at), pa.array(whole)], ["gram", "n", "doc", "place", "at", "whole"])


def _span(doc: Column, place: Column, first: Column, last: Column) -> list[Column]:
    start = F.shiftright(place, 24)
    return [doc.alias("doc"), place.bitwiseAND(0xFFFF).cast("int").alias("salt"),
            (start + first).alias("first"), (start + last).alias("last")]


def repeated_spans(keyed: DataFrame, hot: int = 4096, block_bytes: int = 1 << 19) -> DataFrame:
    """(doc, salt, first, last): stretches of starts of repeated windows, for rows (_doc, _salt, _t)."""
    found = keyed.select("_doc", "_salt", "_t").mapInArrow(_anchored, "gram bigint, ctx bigint, doc bigint, place bigint")
    # Several occurrences, counted with map-side combine; lo = hi: all contexts are equal.
    # Stored, so that the join reads both sides from shuffles and can split a hot gram.
    grams = stored(
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
        .filter("n > 1").select("gram", (F.col("lo") == F.col("hi")).alias("equal")))
    shared = stored(found.join(grams, "gram"))
    count = F.shiftright("place", 16).bitwiseAND(0xFF)
    whole = _span(F.col("doc"), F.col("place"), F.lit(0), count - 1)

    mixed = shared.filter(~F.col("equal"))
    classes = stored(mixed.groupBy("gram", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("one")))
    kinds = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # Equal contexts of a mixed gram are repeated too; the others are compared with one of each kind.
    copies = mixed.join(classes.filter("n > 1").select("gram", "ctx"), ["gram", "ctx"]).select(*whole)
    asked = (
        classes.join(stored(kinds.filter("least = 1")), "gram")
        .select(F.col("one.doc").alias("_doc"), F.col("one.place").bitwiseAND(0xFFFF).cast("int").alias("_salt"),
                F.struct("gram", "n", "one.doc", "one.place", "kinds").alias("_ask"))
        .groupBy("_doc", "_salt").agg(F.collect_list("_ask").alias("_asked")))
    bodies = stored(keyed.select("_doc", "_salt", "_t").join(asked, ["_doc", "_salt"]).select("_t", "_asked").mapInArrow(
        _cut_contexts, "gram bigint, n bigint, doc bigint, place bigint, body binary, kinds bigint"))
    by_sort = (bodies.filter(F.col("kinds") <= hot).drop("kinds")
               .repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_blocks(block_bytes), SPAN))
    single = bodies.filter(F.col("kinds") > hot).drop("kinds").mapInArrow(
        _windows, "gram bigint, n bigint, doc bigint, place bigint, at bigint, whole bigint")
    twice = single.groupBy("gram", "whole").agg(F.sum("n").alias("_all")).filter("_all > 1").drop("_all")
    by_count = single.filter("n = 1").join(twice, ["gram", "whole"]).select(
        *_span(F.col("doc"), F.col("place"), F.col("at"), F.col("at")))
    return shared.filter("equal").select(*whole).union(copies).union(by_sort).union(by_count)


def keyed_rows(docs: DataFrame, text: str, others: Sequence[str] = ()) -> DataFrame:
    """Row key, salt and text as `_doc`, `_salt` and `_t`; `others` are carried under names of our own."""
    body = F.col(f"`{text}`")
    return docs.select(
        row_key(F.col("doc_id"), body).alias("_doc"), F.xxhash64(body).bitwiseAND(0xFFFF).cast("int").alias("_salt"),
        body.alias("_t"), *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(others)])


def dedup(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256; with `keep_text`, `text` is what remains.

    Bytes are removed, not characters: where a cut falls inside a character, what is left of it is
    dropped from the text (not from the digest).
    """
    passed = [c for c in docs.columns if c not in OUTPUT]
    others = [c for c in passed if c != text or not keep_text]
    keyed = keyed_rows(docs, text, others)
    spans = repeated_spans(keyed).groupBy("doc", "salt").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    joined = keyed.join(
        spans.select(F.col("doc").alias("_doc"), F.col("salt").alias("_salt"), "_spans"), ["_doc", "_salt"], "left")
    fields = [*[(c, docs.schema[c].dataType.simpleString()) for c in others],
              *([(text, "string")] if keep_text else []), ("n_bytes", "bigint"), ("n_removed", "bigint"),
              ("n_spans", "bigint"), ("kept_sha256", "string")]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            raw, borders = text_batches(batch.column(0))
            made, left = [], []
            for i, spans_of in enumerate(batch.column(1)):
                body = raw[borders[i]: borders[i + 1]]
                gone, runs = 0, 0
                if spans_of.is_valid:
                    pairs = spans_of.values
                    edge = np.zeros(len(body) + 1, dtype=np.int32)
                    np.add.at(edge, pairs.field(0).to_numpy(), 1)
                    np.add.at(edge, pairs.field(1).to_numpy() + LENGTH, -1)
                    removed = np.cumsum(edge[:-1]) > 0
                    gone = int(removed.sum())
                    runs = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()) if len(removed) else 0
                    rest = body[~removed].tobytes()
                else:
                    rest = body.tobytes()
                made.append((len(body), gone, runs, hashlib.sha256(rest).hexdigest()))
                if keep_text:
                    left.append(rest.decode("utf-8", "ignore") if batch.column(0)[i].is_valid else None)
            numbers = list(zip(*made)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(2, batch.num_columns)),
                 *([pa.array(left, pa.string())] if keep_text else []),
                 *(pa.array(c, k) for c, k in zip(numbers, [pa.int64()] * 3 + [pa.string()]))],
                [name for name, _ in fields])

    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    return joined.select("_t", "_spans", *[f"_p{i}" for i in range(len(others))]).mapInArrow(cut, schema)
