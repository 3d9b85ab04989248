"""Helpers shared by the operators: shared storage, guarded broadcasts, hashed words."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.functions.scale import set_checkpoint_dir

#: Word separators of every operator here, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share, as the session names it; one of our own only where it names none."""
    set_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` as reliable checkpoint files: computed once, lineage cut, any executor may go."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows apart by doc_id and text, whether ids are NULL, repeat or not."""
    return F.xxhash64(doc_id, F.xxhash64(text))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, of which readers take only the columns they use."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, limit: int) -> bool:
    """Whether `df` (stored, so counting is cheap) has at most `limit` rows."""
    return df.limit(limit + 1).count() <= limit


def join_sized(big: DataFrame, side: DataFrame, on: Sequence[str] | Column, how: str, limit: int) -> DataFrame:
    """Join with a stored `side`: broadcast while it has at most `limit` rows, else a shuffle join."""
    return big.join(F.broadcast(side) if small(side, limit) else side, on, how)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def text_batches(batch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column laid end to end, and the n + 1 row borders (NULL: empty)."""
    import pyarrow as pa

    column = batch.cast(pa.large_string()).fill_null("") if not pa.types.is_large_string(batch.type) else batch.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each value (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (n + 1 values)."""
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    last = inside.copy()
    if len(raw):
        cut = borders[(borders > 0) & (borders < len(raw))]
        joined = inside[1:] & inside[:-1]
        joined[cut - 1] = False
        first[1:] &= ~joined
        last[:-1] &= ~joined
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over mixed bytes from prefix sums, mixed again."""
    power = _powers(len(raw), _BASE)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
    inverse = _powers(len(raw), pow(_BASE, -1, 1 << 64))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(raw: np.ndarray, borders: np.ndarray, size: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its word shingles; fewer words than `size` make one."""
    raw = _LOWER[raw] if lower else raw
    starts, ends, before = word_spans(raw, borders)
    hashed = word_hashes(raw, starts, ends)
    odd = _powers(size, 0xD6E8FEB86659FD93)[1:]
    n = len(hashed)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for i in range(size if len(rolled) else 0):
        rolled += hashed[i: i + len(rolled)] * odd[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a: b - size + 1]))
        elif b > a:
            short = (hashed[a:b] * odd[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
