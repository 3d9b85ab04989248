"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), min(least[find(i)], default=None)) for i, (d, s) in enumerate(sets)]


def without_repeats(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of (doc_id, text)."""
    seen = Counter()
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for _, b in bodies:
        seen.update(b[i: i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i: i + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(covered)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n,
            len(w) < 20 or 100 * n > 30 * len(w))


def contained(docs, items, percent=80):
    """(doc_id, item_id, n_item, n_shared)."""
    out = set()
    sets = [(d, shingles((t or "").lower())) for d, t in docs if d is not None]
    for i, t in items:
        q = shingles((t or "").lower())
        for d, s in sets:
            if q and i is not None and 100 * len(q & s) >= percent * len(q):
                out.add((d, i, len(q), len(q & s)))
    return sorted(out)
