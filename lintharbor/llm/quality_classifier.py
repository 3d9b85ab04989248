"""Quality of documents by co-training of two views: the text, and what is known about the page.

The text view sees character n-grams of the raw text (case, signs and layout included), the metadata
view only language, source and length. Each is a logistic regression. In every round each view labels
the documents of an unlabelled pool of which it is surest, as many of either class as the labelled
sample has in proportion, and these become training rows of the other view. After the last round each
view is calibrated on labelled documents kept back (a logistic curve on its log-odds), and a logistic
regression on both log-odds combines them.

The labelled sample has at most `most` documents of each class and the pool at most `pool`; both are
parameters. All documents are scored.

Defined results: NULL and empty texts are scored by their metadata and the text view's bias; NULL
metadata is a value of its own. NULL labels are not learnt from. With labels of one class or none all
scores are that class's, or 0.5. Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, ngrams
from .common import stored
from .language_id import remainder

TEXT, META = 1 << ngrams.BITS, 1 << 12
SCALE = 20.0


def text_row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    index, share = ngrams.counts(ngrams.code_points(text or ""))
    return np.append(index, TEXT), np.append(np.sqrt(share) * 2, 1.0)


def meta_row(lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    size = -1 if n_chars is None else int(2 * math.log2(max(1, n_chars)))
    names = (f"l{lang}", f"s{source}", f"n{size}", f"l{lang}n{size // 2}")
    return np.append([zlib.crc32(n.encode()) % META for n in names], META), np.ones(len(names) + 1)


def log_odds(rows, w: np.ndarray) -> np.ndarray:
    z = linear.logits(rows, w)
    return z[:, 1] - z[:, 0]


def curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression of y on the columns of x and a constant, with a small ridge, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def co_train(views, y: np.ndarray, pool_views, rounds: int, growth: int) -> list[np.ndarray]:
    """Weights of each view; `views` and `pool_views` hold rows per view in the same order of documents."""
    sizes = (TEXT + 1, META + 1)
    options = ({"alpha": 0.3, "l1": 0.01}, {"alpha": 0.3, "l1": 0.05})
    rows = [list(v) for v in views]
    labels = [list(y) for _ in views]
    free = [np.ones(len(pool_views[0]), dtype=bool) for _ in views]
    share = float(np.mean(y))
    for k in range(rounds + 1):
        w = [linear.train(rows[v], np.array(labels[v]), 2, sizes[v], epochs=2, **options[v]) for v in (0, 1)]
        if k == rounds or not len(pool_views[0]):
            return w
        for teacher, learner in ((0, 1), (1, 0)):
            order = np.argsort(log_odds(pool_views[teacher], w[teacher]), kind="stable")
            order = order[free[learner][order]]
            good = round(growth * share)
            for chosen, label in ((order[::-1][:good], 1), (order[: growth - good], 0)):
                for i in chosen.tolist():
                    if free[learner][i]:
                        free[learner][i] = False
                        rows[learner].append(pool_views[learner][i])
                        labels[learner].append(label)
    return w


def fit(sample: list, pool: list, rounds: int = 3, growth: int = 200):
    """From rows (text, lang, source, n_chars, label) and the pool's without label: weights and curves, or None."""
    y = np.array([r[4] for r in sample])
    if len(set(y.tolist())) < 2:
        return None
    rows = [[text_row(r[0]) for r in sample], [meta_row(*r[1:4]) for r in sample]]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2:
        held = np.ones(len(y), dtype=bool)
    learn = ~held if not held.all() else held
    pools = [[text_row(r[0]) for r in pool], [meta_row(*r[1:4]) for r in pool]]
    w = co_train([[r for r, k in zip(v, learn) if k] for v in rows], y[learn], pools, rounds, growth)
    odds = np.column_stack([log_odds([r for r, k in zip(v, held) if k], x) for v, x in zip(rows, w)])
    calibrated = [curve(odds[:, [v]], y[held]) for v in (0, 1)]
    both = np.column_stack([odds[:, v] * calibrated[v][0] + calibrated[v][1] for v in (0, 1)])
    return w, calibrated, curve(both, y[held])


def score(docs: DataFrame, model, constant: float = 0.5, text: str = "text") -> DataFrame:
    """(doc_id, text_score, metadata_score, score) of each document."""
    names = ["doc_id", "text_score", "metadata_score", "score"]
    if model is None:
        return docs.select("doc_id", *[F.lit(float(constant)).alias(n) for n in names[1:]])
    w, calibrated, combined = model
    weights = [(x[:, 1] - x[:, 0]).astype(np.float32) for x in w]

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            odds = np.zeros((batch.num_rows, 2))
            for i, body in enumerate(batch.column(1)):
                for v, (index, value) in enumerate((text_row(body.as_py()), meta_row(*(c[i] for c in columns)))):
                    odds[i, v] = value @ weights[v][index]
            each = [odds[:, v] * calibrated[v][0] + calibrated[v][1] for v in (0, 1)]
            z = [*each, each[0] * combined[0] + each[1] * combined[1] + combined[2]]
            p = [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in z]
            yield pa.RecordBatch.from_arrays([batch.column(0), *p], names)

    return docs.select("doc_id", text, "lang", "source", "n_chars").mapInArrow(
        scored, "doc_id bigint, text_score double, metadata_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = 1500, pool: int = 2000) -> DataFrame:
    """(doc_id, held_out, text_score, metadata_score, score, predicted).

    Learns from labelled rows whose crc32 remainder by 5 is not 0.
    """
    fold = remainder(F.col("doc_id"), 5)
    order = F.xxhash64("doc_id", F.lit(23))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.select("doc_id", F.col("quality").alias("_y")).distinct()
    learn = [stored(known.filter((F.col("_y") == y) & (fold != 0)).orderBy(order, "doc_id").limit(most)) for y in (0, 1)]
    rest = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold != 0)).join(known, "doc_id", "left_anti")
    unknown = stored(rest.distinct().orderBy(order, "doc_id").limit(pool).withColumn("_y", F.lit(-1).cast("bigint")))
    # At most 2 * `most` + `pool` rows of two numbers.
    chosen = F.broadcast(learn[0].union(learn[1]).union(unknown))
    rows = (docs.join(chosen, "doc_id").orderBy(order, "doc_id").limit(2 * (2 * most + pool))
            .select("text", "lang", "source", "n_chars", "_y").collect())
    sample = [(r["text"], r["lang"], r["source"], r["n_chars"], int(r["_y"])) for r in rows if r["_y"] >= 0]
    free = [(r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows if r["_y"] < 0]
    constant = float(np.mean([r[4] for r in sample])) if sample else 0.5
    found = score(docs, fit(sample, free), constant)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text_score", "metadata_score",
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
