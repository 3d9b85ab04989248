"""Language of each text: sparse multinomial logistic regression on TF-IDF character n-grams.

Shares of hashed 1- to 3-grams of the letters are weighted by inverse document frequencies counted
over all training documents. The model is fitted by follow-the-regularised-leader with an elastic net
on at most `per_language` documents of each language, whole and in short cuttings, and its
probabilities are scaled by a temperature fitted on documents kept back. Scoring is one gather of the
weights per n-gram over the whole text.

Defined results: NULL texts and texts without a letter are `und` with score 0, as is every text where
there is nothing to learn from. Rows with NULL language are not learnt from. Repeated rows are scored
alike. An empty table gives an empty result. Ties go to the language first in the alphabet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linear, ngrams
from .common import stored

SCALE = 8.0
DIMENSION = 1 << ngrams.BITS


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def _frequencies(batches):
    import pyarrow as pa

    table, total = ngrams.letter_table(), np.zeros(DIMENSION, dtype=np.int64)
    docs = 0
    for batch in batches:
        for text in batch.column(0):
            b = np.sort(ngrams.buckets(ngrams.letters_only(ngrams.code_points((text.as_py() or "").lower()), table)))
            if len(b):
                docs += 1
                total[b[np.concatenate([[True], b[1:] != b[:-1]])]] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, DIMENSION)), pa.array(np.append(total[used], docs))], ["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all rows; what reaches the driver is one number a bucket."""
    counted = texts.mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in counted}
    frequency = np.zeros(DIMENSION)
    frequency[[b for b in seen if b < DIMENSION]] = [n for b, n in seen.items() if b < DIMENSION]
    return np.log((1 + seen.get(DIMENSION, 0)) / (1 + frequency)) + 1


def cuttings(points: np.ndarray, random: np.random.Generator, n: int = 3) -> list[np.ndarray]:
    """The whole text and `n` stretches of 15 to 150 characters."""
    out = [points]
    for _ in range(n):
        size = int(random.integers(15, 150))
        if len(points) > size:
            at = int(random.integers(0, len(points) - size))
            out.append(points[at: at + size])
    return out


def fit(train: DataFrame, per_language: int = 800, seed: int = 7):
    """(languages, weights with the frequencies folded in, temperature) from rows (text, lang), or None."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"))
    totals = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Hashes are even, so a share of their range holds the least ones of a language that has many rows:
    # few rows a language meet in the window, however many tasks read the table.
    below = {lang: int(-(2**63) + min(1.0, 8 * per_language / n) * (2**64 - 1)) for lang, n in totals.items()}
    if not below:
        return None
    ceiling = F.element_at(F.create_map(*[F.lit(x) for p in below.items() for x in (p[0], min(p[1], 2**63 - 1))]), F.col("lang"))
    narrow = train.select("lang", F.xxhash64("text").alias("_h")).filter(F.col("_h") <= ceiling)
    chosen = stored(narrow.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
                    .filter(F.col("_r") <= per_language).groupBy("lang").agg(F.max("_h").alias("_most")))
    limit = {r["lang"]: r["_most"] for r in chosen.collect()}
    if not limit:
        return None
    languages = sorted(limit)
    # One comparison a language; rows equal to the last chosen text come along, so the number is cut again.
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]), F.col("lang"))
    sample = (train.filter(F.xxhash64("text") <= wanted).withColumn("_r", F.row_number().over(order))
              .filter(F.col("_r") <= per_language).orderBy("lang", "_r").select("lang", "text").collect())
    idf, table, random = inverse_frequencies(train.select("text")), ngrams.letter_table(), np.random.default_rng(seed)
    rows: dict[bool, list] = {False: [], True: []}
    labels: dict[bool, list[int]] = {False: [], True: []}
    for k, r in enumerate(sample):
        points = ngrams.letters_only(ngrams.code_points((r["text"] or "").lower()), table)
        for part in cuttings(points, random):
            index, share = ngrams.counts(part)
            if len(index):
                rows[k % 5 == 4].append((index, share * idf[index] * SCALE))
                labels[k % 5 == 4].append(languages.index(r["lang"]))
    w = linear.train(rows[False], np.array(labels[False]), len(languages), DIMENSION)
    held = np.array(labels[True], dtype=np.int64)
    t = linear.temperature(linear.logits(rows[True], w), held) if len(held) else 1.0
    return languages, (w * idf[:, None] * SCALE).astype(np.float32), t


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, w, t = model

    def scored(batches):
        import pyarrow as pa

        table = ngrams.letter_table()
        for batch in batches:
            named, score = [], []
            for body in batch.column(1):
                points = ngrams.letters_only(ngrams.code_points((body.as_py() or "").lower()), table)
                if not (points != 32).any():
                    named.append("und")
                    score.append(0.0)
                    continue
                b, total = ngrams.buckets(points), np.zeros(w.shape[1])
                for at in range(0, len(b), 1 << 18):
                    total += w[b[at: at + (1 << 18)]].sum(axis=0, dtype=np.float64)
                p = linear.softmax(total / len(b) / t)
                named.append(languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", text).mapInArrow(scored, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows whose crc32 remainder by 3 is not 1."""
    fold = remainder(F.col("doc_id"), 3)
    train = docs.filter(F.col("lang").isNotNull() & (fold != 1)).select("text", "lang")
    found = predict(docs, fit(train, per_language))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
