"""Best-fit packing of token sequences by the configuration linear program.

A configuration is a multiset of piece lengths that fit one sequence. Only the histogram of lengths
(at most `size` numbers, whatever the corpus) reaches the driver. There the program "fewest
configurations that cover the histogram" is solved by multiplicative weights: each round prices the
lengths, takes the best configurations by a bounded knapsack over the capacity (one for each longest
length), and lowers the price of what they used. Rounding leaves a remainder that is solved again, until
it is at most one piece a length and best-fit packed by runs of equal length.
The result, a table of runs "ranks a to b of length L go to sequences from s on", has a size bound by
the number of configurations, and each piece finds its place from its rank among its length.

Defined results: NULL and empty texts are the end id alone. Repeated rows are packed each. NULL doc_id
is kept. An empty table gives no rows.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, vocabulary_path

PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _block int, _rank bigint")


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of `n` ids: one if they fit, else full ones after a first that may be shorter."""
    full = (n - 1) // size
    return [n - full * size, *[size] * full]


def pieces(docs: DataFrame, size: int, path: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece. `_block` and `_rank` number the pieces of each length within a task's rows."""

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path)
        block, counted = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            made = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(body.as_py()).astype("<u4"), end])
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), size)):
                    made.append((doc_id, k, at, n, zlib.crc32(ids[at: at + n].tobytes()), block, int(counted[n])))
                    counted[n] += 1
                    at += n
            columns = list(zip(*made)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", F.col(text).alias("_t")).mapInArrow(encoded, PIECES)


def price(value: np.ndarray, lengths: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounded knapsack by dynamic programming: for each length (ascending) the best configuration in which it
    is the longest. Returns their values and counts (configuration, length)."""
    n, best = len(lengths), np.zeros(size + 1)
    own, total = np.zeros(n, dtype=np.int64), np.zeros(n)
    item, copies, taken = [], [], []
    for i, (length, v) in enumerate(zip(lengths.tolist(), value.tolist())):
        most = int(min(left[i], size // length))
        k = np.arange(1, most + 1)
        worth = k * v + best[size - k * length]
        own[i] = 1 + int(worth.argmax())
        total[i] = worth[own[i] - 1]
        some = 1
        while most:
            some = min(some, most)
            other = best[: size + 1 - some * length] + some * v
            better = np.zeros(size + 1, dtype=bool)
            np.greater(other, best[some * length:], out=better[some * length:])
            np.maximum(best[some * length:], other, out=best[some * length:])
            item.append(i)
            copies.append(some)
            taken.append(better)
            most, some = most - some, 2 * some
    counts = np.zeros((n, n), dtype=np.int16)
    counts[np.arange(n), np.arange(n)] = own
    room = size - own * lengths
    for i, some, better in zip(reversed(item), reversed(copies), reversed(taken)):
        hit = np.flatnonzero(better[room[i + 1:]]) + i + 1
        if len(hit):
            counts[hit, i] += some
            room[hit] -= some * lengths[i]
    return total, counts


def configurations(lengths: np.ndarray, left: np.ndarray, size: int, rounds: int, rate: float = 4.0, step: float = 0.1):
    """Multiplicative weights on the configuration program: configurations (places, numbers) and fractional counts.

    A round prices all lengths once, and takes the configurations near the best price, dearest first and at the
    same price the longest first, as long as it covers no more than `step` of a length.
    """
    use = np.zeros(len(lengths))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        value = lengths * np.exp(-rate * use / left)
        total, counts = price(value, lengths, left, size)
        now = np.zeros(len(lengths))
        top = np.lexsort((-lengths, -np.round(total / total.max(), 6)))
        for i in top[total[top] >= 0.6 * total.max()].tolist():
            hit = np.flatnonzero(counts[i])
            a = counts[i][hit].astype(np.int64)
            amount = float(((step * left[hit] - now[hit]) / a).min())
            if amount < 0.25 * step * float((left[hit] / a).min()):
                continue
            now[hit] += a * amount
            found.setdefault(hit.tobytes() + a.tobytes(), [hit, a, 0.0])[2] += amount
        use += now
        # What the fractions do not cover yet is part of what the next run of the program covers.
        if (lengths * np.maximum(left - use, 0)).sum() <= 0.1 * (lengths * left).sum():
            break
    return list(found.values())


def best_fit(left: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit in decreasing length, by runs of equal length over groups of sequences filled alike."""
    groups: dict[int, dict[tuple, int]] = {}
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            room = min((r for r in groups if r >= n), default=size)
            filled, bins = groups[room].popitem() if room in groups else ((), c)
            if room in groups and not groups[room]:
                del groups[room]
            # The sequence just used has the least room, so it takes as many as fit before the next one does.
            k = min(room // n, c)
            times = min(bins, c // k)
            to = groups.setdefault(room - k * n, {})
            to[(*filled, (n, k))] = to.get((*filled, (n, k)), 0) + times
            if filled and bins > times:
                groups.setdefault(room, {})[filled] = bins - times
            c -= k * times
    return [(list(filled), times) for alike in groups.values() for filled, times in alike.items()]


def plan(histogram: dict[int, int], size: int, rounds: int = 150, rest: int = 20_000) -> tuple[np.ndarray, dict[str, int]]:
    """Runs (length, first rank, per sequence, first sequence, offset), sorted, for a histogram of lengths, and the
    numbers of pieces placed full, by configurations and by best fit.

    The program runs at every size, and again on what rounding left until that is at most one piece a length (and
    at most `rest`).
    """
    runs, sequence = [], 0
    placed = {n: 0 for n in histogram}
    left = {n: c for n, c in histogram.items() if c}
    by = {"full": left.get(size, 0), "configurations": 0, "best_fit": 0}
    if left.get(size):
        runs.append((size, 0, 1, 0, 0))
        sequence = left.pop(size)

    def put(config: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n, k in config:
            runs.append((n, placed[n], k, sequence, offset))
            placed[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times

    least, step, first = min(rest, len(left)), 0.25, True
    while (first and left) or sum(left.values()) > least:
        lengths = np.array(sorted(n for n, c in left.items() if c), dtype=np.int64)
        counts = np.array([left[n] for n in lengths.tolist()], dtype=np.int64)
        found = configurations(lengths, counts, size, rounds, step=step)
        found.sort(key=lambda f: size - int((f[1] * lengths[f[0]]).sum()))
        # Rounding: whole numbers whose running sum follows the running sum of the fractions.
        share, before = 0.5, 0
        for hit, a, x in found:
            share += x
            times = min(int(share) - before, int((counts[hit] // a).min()))
            before = int(share)
            if times > 0:
                counts[hit] -= times * a
                put([(int(lengths[i]), int(k)) for i, k in zip(hit, a)], times)
                by["configurations"] += times * int(a.sum())
        # From a step of 1 on, each configuration uses up a length.
        step, first = min(1.0, 3 * step), False
    by["best_fit"] = sum(left.values())
    for config, times in best_fit(dict(left), size):
        put(config, times)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), by


def plan_packing(histogram: dict[int, int], size: int, rounds: int = 150, rest: int = 20_000) -> np.ndarray:
    """The runs of `plan`."""
    return plan(histogram, size, rounds, rest)[0]


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 0, text: str = "text") -> DataFrame:
    """Pieces of all documents with `sequence_id` and `offset`."""
    cut = stored(pieces(docs, size, path or vocabulary_path(), end_id, text))
    counts = stored(cut.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, by = plan(histogram, size)
    print("packing: pieces placed " + ", ".join(f"{k} {n}" for k, n in by.items()), file=sys.stderr)
    # One row a task and length: a short window for each length.
    order = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("length", "_block", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))

    def placed(batches):
        import pyarrow as pa

        length, first, per, sequence, offset = (np.ascontiguousarray(c) for c in runs.T)
        # Runs are sorted by length, then rank: one key finds the run of a piece.
        key = length.astype(np.float64) * 2.0**41 + first
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = np.searchsorted(key, n * 2.0**41 + rank, side="right") - 1
            seat = rank - first[k]
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[k] + seat // per[k]), pa.array(offset[k] + seat % per[k] * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(starts, ["length", "_block"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))
    return ranked.mapInArrow(placed, (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))
