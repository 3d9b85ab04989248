"""Toxic documents by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words sums over the subsequences of three letters they share, each weighted by
DECAY ** (its span in the word), spans up to SPAN letters; so a letter put in between, doubled or left
out costs a part of the similarity only. Words count with a mark at either end, without what is not a
letter; letters written apart are one word.

Training. Labels belong to documents, of which a bounded sample is read. All sentences take part: those
of clean documents are clean, those of toxic ones are bags of words of which the worst, the witness,
makes a sentence toxic or not. First witnesses are words that toxic documents use beyond chance. Landmarks
are picked among the words of both sides by pivoted Cholesky of the kernel, words map to Nyström
features, and a linear SVM is trained on the witnesses (also gapped and with letters inserted) against
the words of clean sentences. Each round adds the clean words it takes wrongly, and goes over all
sentences of toxic documents again: the witness of each is the word with the largest margin, where
that is beyond nearly all clean words.

As the kernel is a product of sparse vectors, landmarks and SVM weights fold into one weight for each
subsequence. Scoring a word is a sum over its subsequences, a document counts by its `WORST` worst words,
and a logistic curve fitted on the sample's documents turns their margins into a score.

Defined results: NULL and empty texts, and texts without letters, have the score of no evidence. Where
nothing toxic is labelled all scores are 0. Labels of rows that are repeated count once each; NULL
labels are not learnt from. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import nlargest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored
from .language_id import remainder

SPAN, DECAY, BITS, LONGEST = 6, 0.6, 20, 24
#: Words of a document that count.
WORST = 3
_SPLIT = re.compile(r"[.!?\n]+")
_APART = re.compile(r"(?<!\S)\S(?:[ ._*-]\S){2,}(?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_CACHE = 300_000


def letters_of(word: str) -> str:
    return _NOT_LETTER.sub("", word)


def words_of(text: str) -> list[str]:
    """Lower-cased words with their signs; letters written apart also as one word."""
    low = text.lower()
    found = low.split()
    for m in _APART.finditer(low):
        found.append(letters_of(m[0]))
    return found


def pieces_of(word: str) -> list[str]:
    """The letters of a word, in overlapping stretches where it is longer than any insult."""
    w = letters_of(word)
    return [w] if len(w) <= LONGEST else [w[i: i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket, weight) of all subsequences of three letters; weights have about unit norm per word."""
    joined = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    number, bucket, weight = [], [], []
    at = np.arange(len(c))
    for last in range(2, SPAN):
        ok = at[at + last < end]
        for mid in range(1, last):
            h = (c[ok] * np.uint64(0x9E3779B1) + c[ok + mid]) * np.uint64(0x85EBCA6B) + c[ok + last]
            number.append(of[ok])
            bucket.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
            weight.append(np.full(len(ok), DECAY ** (last + 1)))
    number, bucket, weight = (np.concatenate(x) if x else np.zeros(0, t) for x, t in (
        (number, np.int64), (bucket, np.int64), (weight, float)))
    norm = np.sqrt(np.bincount(number, weight**2, minlength=len(words)))
    return number, bucket, weight / norm[number]


def margins(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    number, bucket, weight = subsequences(words)
    return np.bincount(number, weight * table[bucket], minlength=len(words)) + bias


def kernel_with(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values (word, landmark)."""
    ln, lb, lw = subsequences(landmarks)
    known, place = np.unique(lb, return_inverse=True)
    number, bucket, weight = subsequences(words)
    slot = np.minimum(np.searchsorted(known, bucket), max(0, len(known) - 1))
    hit = known[slot] == bucket if len(known) else np.zeros(len(bucket), dtype=bool)
    number, slot, weight = number[hit], slot[hit], weight[hit]
    out = np.zeros((len(words), len(landmarks)))
    for k in range(len(landmarks)):
        mine = ln == k
        row = np.bincount(place[mine], lw[mine], minlength=len(known))
        out[:, k] = np.bincount(number, weight * row[slot], minlength=len(words))
    return out


def features(words: list[str], landmarks: list[str], root: np.ndarray, some: int = 2000) -> np.ndarray:
    """Nyström features of the words and a constant one, in blocks."""
    out = np.ones((len(words), len(landmarks) + 1), dtype=np.float32)
    for at in range(0, len(words), some):
        out[at: at + some, :-1] = kernel_with(words[at: at + some], landmarks) @ root
    return out


def landmarks_of(pool: list[str], most: int) -> list[str]:
    """Pivoted Cholesky: each landmark is the word that those before explain least."""
    number, bucket, weight = subsequences(pool)
    by_word = np.argsort(number, kind="stable")
    border = np.searchsorted(number[by_word], np.arange(len(pool) + 1))
    rest, chosen, rows = np.ones(len(pool)), [], np.zeros((most, len(pool)))
    for k in range(min(most, len(pool))):
        i = int(rest.argmax())
        if rest[i] < 1e-3:
            break
        own = by_word[border[i]: border[i + 1]]
        row = np.bincount(bucket[own], weight[own], minlength=1 << BITS)
        column = np.bincount(number, weight * row[bucket], minlength=len(pool))
        rows[k] = (column - rows[:k].T @ rows[:k, i]) / np.sqrt(rest[i])
        rest = np.maximum(rest - rows[k] ** 2, 0)
        rest[i] = 0
        chosen.append(pool[i])
    return chosen


def gapped(word: str, random: np.random.Generator) -> str:
    """The word with one or two strange letters inserted, or a letter doubled."""
    w = list(word)
    for _ in range(int(random.integers(1, 3))):
        i = int(random.integers(1, len(w))) if len(w) > 1 else 0
        w.insert(i, w[i] if random.random() < 0.3 else chr(97 + int(random.integers(0, 26))))
    return "".join(w)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20000.0, rounds: int = 25) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin; the last feature is the bias."""
    weight = 2 * cost * weight / weight.sum()
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    inside = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        square, side = ridge.copy(), np.zeros(x.shape[1])
        for at in range(0, len(y), 2000):
            some = np.flatnonzero(inside[at: at + 2000]) + at
            xi, di = x[some].astype(np.float64), weight[some]
            square += (xi * di[:, None]).T @ xi
            side += xi.T @ (di * y[some])
        w = np.linalg.solve(square, side)
        now = y * (x @ w.astype(np.float32)) < 1
        if (now == inside).all():
            break
        inside = now
    return w


class Model:
    """Weights of subsequences, and the curve from a document's worst words to its score."""

    def __init__(self, table: np.ndarray, bias: float, weights: np.ndarray, middle: float):
        self.table, self.bias, self.weights, self.middle = table, bias, weights, middle

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst @ self.weights - self.middle, -30, 30)))


def worst_words(texts: list[str | None], table: np.ndarray, bias: float, kept: dict[str, float]) -> np.ndarray:
    """The `WORST` largest margins among the different words of each whole text; -1 where there are fewer."""
    sets = [set(words_of(t)) if t else set() for t in texts]
    new = {w for words in sets for w in words if w not in kept}
    if len(kept) + len(new) > _CACHE:
        kept.clear()
        new = {w for words in sets for w in words}
    if new:
        names = list(new)
        parts = [pieces_of(w) for w in names]
        flat = [p for ps in parts for p in ps]
        value = margins(flat, table, bias)
        value[[not p for p in flat]] = -1.0
        first = np.cumsum([0] + [len(p) for p in parts])[:-1]
        kept.update(zip(names, np.maximum.reduceat(value, first).tolist()))
    none = [-1.0] * WORST
    return np.array([(nlargest(WORST, map(kept.__getitem__, words)) + none)[:WORST] for words in sets]).reshape(-1, WORST)


def curve(worst: np.ndarray, label: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights of the worst words and the middle of the score, fitted on documents.

    Several bad words say more than one. A logistic regression weighs them; no weight is negative, so a
    worse word never makes a text better. The middle is put where a share of clean documents flagged weighs
    as much as eight times that share of toxic ones missed.
    """
    x = np.column_stack([worst, np.ones(len(worst))])
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.02 * len(label)] * WORST + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (share * (label - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.maximum(w[:WORST], 0.1)
    # Scores should part clearly: a unit of margin is worth several units of evidence.
    weights *= 8.0 / weights.sum()
    value = worst @ weights
    cuts = np.unique(np.quantile(value, np.linspace(0, 1, 400)))
    right = [(np.mean(value[label == 1] >= c) + 8 * np.mean(value[label == 0] < c)) for c in cuts]
    top = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    middle = float(cuts[top].mean())
    if top[0] > 0:
        middle = float((cuts[top[-1]] + cuts[top[0] - 1]) / 2)
    return weights, middle


def telling_words(used: dict[int, Counter], docs: Counter, share: float = 0.2) -> dict[str, float]:
    """Words that toxic documents use beyond chance, with the logarithm of how much more often.

    `used` counts the documents of each class that hold a word. Were labels dealt at random, a word held
    by n documents would be held by toxic ones only with probability p ** n, p the share of toxic documents;
    with k others among them the chance is bounded alike. Words are accepted in order of that chance as
    long as less than `share` of them are expected by luck, whatever the size of the sample.
    """
    p = docs[1] / (docs[0] + docs[1])
    chance = {}
    for w, n in used[1].items():
        k = used[0][w]
        odds = np.log((n + 0.1) / docs[1]) - np.log((k + 0.1) / docs[0])
        if n + k > 1 and odds > 0:
            # Chernoff bound of n or more out of n + k at probability p.
            rate = n / (n + k)
            chance[w] = (-(n + k) * (rate * np.log(rate / p) + (0 if k == 0 else (1 - rate) * np.log((1 - rate) / (1 - p)))), odds)
    order = sorted(chance, key=lambda w: (chance[w][0], w))
    last = 0
    for rank, w in enumerate(order, 1):
        if np.exp(chance[w][0]) * len(order) <= share * rank:
            last = rank
    return {w: chance[w][1] for w in order[:last] if chance[w][1] > 3.0}


def witnesses(sentences: list[list[str]], margin: dict[str, float], least: float) -> Counter:
    """The word the machine takes for worst in each sentence of toxic documents, where it is beyond `least`."""
    found: Counter = Counter()
    for words in sentences:
        worst = max(words, key=margin.__getitem__, default=None)
        if worst is not None and margin[worst] > least:
            found[worst] += 1
    return found


def fit(sample: list[tuple[str, int]], n_landmarks: int = 320, rounds: int = 4, seed: int = 11) -> Model | None:
    """From (text, toxic) of the sampled documents."""
    random = np.random.default_rng(seed)
    used: dict[int, Counter] = {0: Counter(), 1: Counter()}
    docs = Counter(y for _, y in sample)
    for text, y in sample:
        used[y].update({p for w in words_of(text or "") for p in pieces_of(w) if len(p) >= 3})
    if not docs[1] or not docs[0]:
        return None
    telling = telling_words(used, docs)
    if not telling:
        return None
    # Ties by the word, so that reruns agree.
    clean = sorted(used[0], key=lambda w: (-used[0][w], w))
    del used
    # Every sentence of every toxic document is a bag of words; which word made it toxic is not labelled.
    sentences = [
        sorted({p for w in words_of(sentence) for p in pieces_of(w) if p})
        for text, y in sample if y for sentence in _SPLIT.split(text or "")]
    inside = sorted({w for words in sentences for w in words})
    # The machine has seen nothing yet: its first witnesses are the words that tell the classes apart.
    witness = witnesses(sentences, {w: telling.get(w, -1.0) for w in inside}, 0.0)
    pick = random.permutation(len(clean))
    negative = [*clean[:2000], *(clean[i] for i in pick[:6000])]
    common = [w for w, _ in witness.most_common(n_landmarks // 4)]
    others = landmarks_of([*list(witness)[:2000], *negative[:2000]], n_landmarks)
    landmarks = list(dict.fromkeys([*common, *others]))[:n_landmarks]
    inner = kernel_with(landmarks, landmarks)
    value, vector = np.linalg.eigh(inner + 1e-6 * np.eye(len(landmarks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    ln, lb, lw = subsequences(landmarks)
    table, bias, seen = np.zeros(1 << BITS), 0.0, set(negative)
    for done in range(rounds):
        positive = list(witness)
        varied = [*positive, *(gapped(w, random) for w in positive for _ in range(2))]
        counted = np.array([*(float(witness[w]) for w in positive), *([2.0] * (2 * len(positive)))])
        x = features([*varied, *negative], landmarks, root)
        y = np.concatenate([np.ones(len(varied)), -np.ones(len(negative))])
        weight = np.concatenate([counted / counted.sum(), np.full(len(negative), 1 / len(negative))])
        w = svm(x, y, weight)
        beta, bias = root @ w[:-1], float(w[-1])
        table = np.zeros(1 << BITS)
        np.add.at(table, lb, lw * beta[ln])
        clean_margin = np.concatenate([margins(clean[i: i + 4000], table, bias) for i in range(0, len(clean), 4000)])
        hard = [clean[i] for i in np.argsort(-clean_margin)[:3000] if clean[i] not in seen]
        seen.update(hard)
        negative += hard
        if done + 1 < rounds:
            # From now on the machine chooses: in each sentence its worst word, if hardly a clean word is as bad.
            own = np.concatenate([margins(inside[i: i + 4000], table, bias) for i in range(0, len(inside), 4000)])
            least = max(0.0, float(np.quantile(clean_margin, 0.999)))
            witness = witnesses(sentences, dict(zip(inside, own.tolist())), least) or witness
    worst = np.concatenate([
        worst_words([t for t, _ in sample[i: i + 200]], table, bias, {}) for i in range(0, len(sample), 200)])
    return Model(table, bias, *curve(worst, np.array([y for _, y in sample])))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    used = np.flatnonzero(model.table)
    bucket, value, bias = used.astype(np.int32), model.table[used], model.bias
    weights, middle = model.weights, model.middle

    def scored(batches):
        import pyarrow as pa

        table, kept = np.zeros(1 << BITS), {}
        table[bucket] = value
        fitted = Model(table, bias, weights, middle)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(at, 500).to_pylist()
                found.append(fitted.score(worst_words(texts, table, bias, kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(scored, "doc_id bigint, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, label: str = "toxic") -> list[tuple[str, int]]:
    """At most `most` labelled texts of each class, in the order of a hash of the id."""
    order = F.xxhash64("doc_id", F.lit(17))
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_y")).distinct()
    parts = [stored(rows.filter(F.col("_y") == y).orderBy(order, "doc_id").limit(most)) for y in (0, 1)]
    # At most 2 * `most` rows of two numbers: a bound that the parameter sets.
    chosen = F.broadcast(parts[0].union(parts[1]))
    # One text for each id and label, however often they repeat, and one row for texts alike.
    texts = docs.join(chosen, "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).orderBy(order, "doc_id", "_y")
    return list(dict.fromkeys((r["text"], int(r["_y"])) for r in texts.select("text", "_y").collect()))


def classify(docs: DataFrame, labels: DataFrame, most: int = 2500) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from rows whose crc32 remainder by 5 is not 0."""
    fold = remainder(F.col("doc_id"), 5)
    found = score(docs, fit(labelled_sample(docs, labels.filter(fold != 0), most)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
