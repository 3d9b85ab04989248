"""Filter audit, source mixing and Merkle manifest against plain versions, on awkward rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from lintharbor.llm import filter_audit, merkle_manifest, source_mixing  # noqa: E402

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, mask string, n string, key string, "
          "size string, epoch string, tree string, leaf string, idx string, _s string, _row string, _mix string")
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(60_000, 1)
SAME = prose(250, 2)
ROWS = [
    (1, SAME, "en", "a"), (2, SAME, "en", "a"), (3, SAME, None, None), (4, SAME + " ", "en", "b"), (5, SAME[:-1], "de", "b"),
    (6, None, "en", "a"), (7, "", "de", "a"), (8, "", "", None), (9, " \t\n ", "en", "é"), (10, "One TWO", "en", "é"),
    (11, "ONE TWO THREE " * 80, "de", "a"), (12, prose(220, 3) + " #", "en", "b"), (13, LONG, "en", "c"), (14, LONG, "fr", "c"),
    (None, SAME, "en", "a"), (None, "alone", "de", "b"), (None, None, None, None), (None, SAME, "en", "a"),
    (15, "twice", "en", "b"), (15, "twice", "en", "b"), (15, "other", "fr", "c"), (16, "twice", "en", "b"),
    (17, "a\x1cb\x85c d", "en", "empty"), (18, "\U0001F600 é²", "de", ""), (-4, "twice", "fr", "z"),
] + [(100 + i, prose(201 + i % 3, i % 40), ("en", "de")[i % 2], "hot") for i in range(120)]
LABELS = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (13, None, None), (15, 1, 1), (15, 0, 0), (None, 1, 1), (999, 1, 1), (14, 1, 0), (11, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, lang, s, None if t is None else len(t), *["x"] * 11) for d, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- Filter audit ---------------------------------------------------------------------------

def plain_masks(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, lang, _ in rows:
        t, w = t or "", brute.words(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 bool(set(t) & set("#$%&*|")), d is not None and d > least[t]]
        out.append((d, lang or "", sum(1 << i for i, x in enumerate(fails) if x)))
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = plain_masks(rows)
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in masks}:
        for order in permutations("ABCDE"):
            left = [(d, m) for d, p, m in masks if p == part]
            whole = list(left)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(d, m) for d, m in left if m & bit]
                left = [(d, m) for d, m in left if not m & bit]
                failing = sum(bool(m & bit) for _, m in whole)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(m == bit for _, m in whole),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
                shapley[part, letter] += len(gone)
    return sorted((*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def labels_of(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("options", [{}, {"window_bytes": 3000, "limit": 2000}, {"window_bytes": 1, "limit": 1}])
def test_masks_equal_brute_force_however_texts_are_dealt_out(docs, options):
    got = filter_audit.fail_masks(docs, **options).withColumn("n", F.col("n").cast("int"))
    rows = [(r.doc_id, r.part, r["mask"]) for r in got.collect() for _ in range(r.n)]
    assert sorted(rows, key=repr) == sorted(plain_masks(ROWS), key=repr)


def test_audit_equals_every_order_played_through(spark, docs):
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels_of(spark)).select(*AUDIT).collect())
    assert got == plain_audit(ROWS, LABELS)


def test_audit_of_empty_tables(spark, docs, none):
    assert filter_audit.audit(none, labels_of(spark)).count() == 0
    lost = filter_audit.audit(docs, labels_of(spark).limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(lost) == (0, 0)


def test_trie_holds_least_ids_at_terminals():
    r = random.Random(1)
    texts = ["", "a", "ab", "abc", "abd", "b" * 500, "b" * 499 + "c", "b" * 200] + [
        "".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(400)]
    trie = filter_audit.Trie()
    for i, t in enumerate(texts):
        trie.insert(t.encode(), 1000 - i, t)
    ends = list(trie.walk())
    assert len(ends) == len(set(texts))
    for end in ends:
        assert len(set(end.rows)) == 1
        assert end.least == min(1000 - i for i, t in enumerate(texts) if t == end.rows[0])


def test_texts_of_a_window_are_held_once():
    import tracemalloc

    import pyarrow as pa

    r = random.Random(7)
    texts = [r.randbytes(2000).hex() for _ in range(3000)]
    texts[1000:1100] = [texts[5]] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(["en"] * 3000), pa.array(texts)], ["doc_id", "part", "text"])
    total = sum(map(len, texts))
    tracemalloc.start()
    try:
        got = {}
        for out in filter_audit._local(64 << 20)([batch]):
            assert out.nbytes < 3 << 20
            for doc_id, opened, text in zip(*(out.column(c).to_pylist() for c in ("doc_id", "open", "text"))):
                got[doc_id] = (opened, text is None or hash(text) == hash(texts[doc_id]))
        assert tracemalloc.get_traced_memory()[1] < 1.8 * total
    finally:
        tracemalloc.stop()
    assert got == {i: (not 1000 <= i < 1100, True) for i in range(3000)}


def test_word_counts_in_chunks(monkeypatch):
    monkeypatch.setattr(filter_audit, "_CHUNK", 7)
    for t in ("", "  ", prose(300, 9), " a\tb\n" * 30, "x" * 50):
        assert filter_audit.word_counts(t.encode()) == (len(brute.words(t)), len(set(brute.words(t))))


# --- Source mixing --------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """By the rule as it is told: share, stop those above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in stopped)
        open_weight = sum(w[s] for s in names if s not in stopped)
        target = {s: cap * sizes[s] if s in stopped else rest * w[s] / open_weight for s in names}
        above = {s for s in names if s not in stopped and target[s] > cap * sizes[s]}
        if not above:
            return target
        stopped |= above


def sizes_of(rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(brute.words(t))
    return sizes


def test_mix_meets_every_target(docs):
    got = source_mixing.mix(docs).collect()
    sizes, target = sizes_of(ROWS), plain_targets(sizes_of(ROWS))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(
        ((d, s, len(brute.words(t))) for d, t, _, s in ROWS), key=repr)
    taken, rows_at = defaultdict(int), Counter(s for _, _, _, s in ROWS)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1 + (rows_at[s] if s in ("a", "b") else 0)
    # Whole epochs first: no row is taken twice while another of its source is not taken once.
    for s in sizes:
        epochs = [r.taken // r.size for r in got if r.source == s and r.size]
        assert not epochs or max(epochs) - min(epochs) <= 1


def test_targets_of_many_sources(spark):
    r = random.Random(4)
    for case in range(6):
        sizes = {f"s{i:03}": r.choice([0, 1, 5, 100, 10_000]) * r.randint(1, 9) for i in range(40)} | {None: 17 * case}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {x.source: x.target for x in source_mixing.targets(rows).collect()}
        assert got == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}


def test_reruns_agree_and_buckets_do_not_matter(docs):
    def taken(df):
        return rows_of(source_mixing.mix(df), "doc_id", "source", "taken")

    assert taken(docs) == taken(docs.repartition(7))
    keyed = docs.select("source", source_mixing.order_key(F.col("doc_id"), F.col("text"), "x").alias("key"),
                        source_mixing.n_words(F.col("text")).alias("size"))
    budgets = source_mixing.targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")))
    cuts = [rows_of(source_mixing.cuts(keyed, budgets, bucket_rows=n), "source", "epochs", "cut", "at_cut") for n in (1 << 12, 16, 2)]
    assert cuts[0] == cuts[1] == cuts[2]


def test_mixture_holds_the_words_that_mix_takes(docs):
    mixed = source_mixing.mixture(docs)
    assert set(docs.columns) | {"epoch", "size"} == set(mixed.columns)
    words = Counter()
    for r in mixed.collect():
        assert len(brute.words(r.text)) == r.size
        words[r.source] += r.size
    taken = Counter()
    for r in source_mixing.mix(docs).collect():
        taken[r.source] += r.taken
    assert +words == +taken


def test_mix_of_empty_table_and_of_one_source(spark, none):
    assert source_mixing.mix(none).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s"), (3, None, "t")], "doc_id bigint, text string, source string")
    assert rows_of(source_mixing.mix(one), "doc_id", "target", "taken") == [(1, 4.0, 3), (2, 4.0, 1), (3, 0.0, 0)]


# --- Merkle manifest ------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(d, source, lang, n, t):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, t)])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i: i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(i, levels):
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16: i // 16 * 16 + 16]
        yield run[: i % 16], run[i % 16 + 1:]
        i //= 16


def plain_manifest(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by_source = defaultdict(list)
    for d, t, lang, s in rows:
        n = None if t is None else len(t)
        leaf = plain_leaf(d, s, lang, n, t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by_source[s].append((d, leaf, plain_leaf(d, s, lang, n, t and t.translate(lower)) if hit else leaf))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_levels([leaf for _, leaf, _ in by_source[s]])
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, (d, leaf, folded) in enumerate(by_source[s]):
            steps = [*plain_path(i, trees[s]), *plain_path(place, top)]
            for left, right in steps:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in steps for x in left + right])
            out.append((d, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_equals_brute_force(docs):
    assert rows_of(merkle_manifest.manifest(docs), *MANIFEST) == plain_manifest(ROWS)


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of 16 leaves, so that the levels above them are many."""
    monkeypatch.setattr(merkle_manifest, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 16)


def test_manifest_of_many_blocks_and_sources(spark, small_blocks):
    rows = [(i, f"Text {i}", "en", "hot") for i in range(16 * 16 * 3 + 1)]
    rows += [(5000 + i, f"T {i}", None, f"s{i}") for i in range(270)] + [(9000 + i, "U", "de", None) for i in range(17)]
    df = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    expected = plain_manifest(rows)
    assert rows_of(merkle_manifest.manifest(df), *MANIFEST) == expected
    # Beyond the bounds of its broadcasts as well.
    assert rows_of(merkle_manifest.manifest(df, broadcast_nodes=1, broadcast_blocks=1), *MANIFEST) == expected


def test_proofs_fold_to_the_root_and_nothing_else_does(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)]
    df = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = merkle_manifest.manifest(df, tampered=F.col("doc_id") == 7, with_proof=True).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]
    assert all(h(*r.proof) == r.proof_sha256 for r in got)


def test_missing_nodes_are_the_least_union():
    for width in (1, 2, 16, 17, 255, 256, 4097):
        r = random.Random(width)
        chosen = set(r.sample(range(width), min(width, 9)))
        levels = plain_levels([str(i) for i in range(width)])
        asked = list(merkle_manifest.missing(chosen, width))
        assert len(asked) == len(set(asked))
        fetched = {}
        for level, i in asked:
            fetched.setdefault(level, {})[i] = levels[level][i]
        root, _ = merkle_manifest.climb({i: str(i) for i in chosen}, width, fetched)
        assert root == levels[-1][0]
        # Without any one of them the root cannot be derived.
        for level, i in asked[:20]:
            less = {k: {j: x for j, x in v.items() if (k, j) != (level, i)} for k, v in fetched.items()}
            with pytest.raises(KeyError):
                merkle_manifest.climb({i: str(i) for i in chosen}, width, less)


def test_manifest_of_empty_table_and_single_row(spark, none):
    assert merkle_manifest.manifest(none).count() == 0
    one = spark.createDataFrame([(3, "A", None, None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert rows_of(merkle_manifest.manifest(one), *MANIFEST) == plain_manifest([(3, "A", None, None)])
