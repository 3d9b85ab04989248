"""Each operator against a brute-force version, on awkward rows: NULLs, empty and long texts, ties, repeats, clashes."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from lintharbor.llm import (  # noqa: E402
    common,
    decontamination,
    language_id,
    license_scan,
    linear,
    ngram_join,
    ngrams,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_records,
    tokens,
    toxicity,
)

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "kept string, n_bytes string, sig string, token string, start string, score string")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def changed(text, at):
    w = text.split()
    for i in at:
        w[i] = f"new{i}"
    return " ".join(w)


BASE = prose(120, 1)
PASSAGE = prose(60, 2)
ITEM = prose(30, 3)
LONG = prose(9000, 4)
TEXTS = [
    (1, BASE), (2, BASE), (3, changed(BASE, [50])), (4, changed(BASE, [50, 90])), (5, changed(BASE, range(0, 120, 9))),
    (6, None), (7, ""), (8, " \t\n "), (9, "one two three"), (10, "ONE two three"), (11, "one two three four five"),
    (12, prose(80, 6) + " " + PASSAGE + " " + prose(80, 7)), (13, prose(90, 8) + " " + PASSAGE + "\n" + prose(40, 9)),
    (14, LONG), (15, LONG + " tail"), (16, "x" * 3000), (17, "x" * 190), (18, "ab" * 500 + "é" * 300),
    (19, prose(40, 10) + " " + ITEM + " " + prose(400, 11)), (20, changed(ITEM, [14])), (21, changed(ITEM, [5, 14, 22])),
    (22, (prose(12, 12) + "\n") * 6), (23, BASE + " " + BASE), (None, prose(50, 13)), (None, BASE),
    (24, prose(30, 14)), (24, prose(30, 14)), (24, prose(31, 15)), (25, "é²Ⅷ あ ５ x\x1fy \U0001F600\U00010330 'll"),
    (26, "a#b$ *c* |d| <e> & %f%\n\na#b$\na#b$"), (27, prose(100, 16).upper()), (28, prose(100, 16)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if (d or 0) % 7 == 0 else ("en", "de")[(d or 0) % 2], None if d == 3 else "s", None if t is None else len(t),
             "k", "b", "s", "t", "st", "sc") for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_shingle_hashes_depend_on_the_words_alone(spark):
    import pyarrow as pa

    texts = ["A b c d e f", "x A  b\tc d e f", "a b", None, "", "a b c"]
    got = common.shingle_sets(*common.text_batches(pa.array(texts, pa.string())))
    assert [len(s) for s in got] == [2, 3, 1, 0, 0, 1]
    assert set(got[0].tolist()) < set(got[1].tolist())
    assert got[2] != got[5]


def test_components_equal_brute_force(docs):
    got = rows_of(ngram_join.components_of(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(TEXTS), key=repr)


def test_components_of_many_near_copies_need_no_pairs(spark):
    """A group whose members differ from each other more than from the middle, and a shared passage."""
    base = prose(150, 20)
    rows = [(i, changed(base, [(7 * i) % 150])) for i in range(60)] + [(100, base)]
    rows += [(200 + i, PASSAGE + " " + prose(20, 300 + i)) for i in range(40)]
    rows += [(300 + i, changed(base, [(11 * i + j * 31) % 150 for j in range(4)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(ngram_join.components_of(df), "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows), key=repr)


def test_one_document_of_each_group_stays(docs, none):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.one_per_group(docs).collect())
    found = brute.components(TEXTS)
    assert found
    # Of each group the row with the least id; rows alike in id and text are one, rows without an id stay.
    rows = sorted({(d, t) for d, t in TEXTS if d is not None}, key=repr)
    groups = {}
    for (d, t), (_, _, c) in zip(rows, brute.components([(i, t) for i, (_, t) in enumerate(rows)])):
        groups.setdefault(c, []).append(d)
    assert got == sorted((False, min(g)) for g in groups.values()) + [(True, 0)] * 2
    assert ngram_join.one_per_group(docs).columns == docs.columns
    assert ngram_join.components_of(none).collect() == []


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in ngram_join.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_decontamination_equals_brute_force(spark, docs, none):
    items = [(1, ITEM), (2, prose(14, 30)), (3, None), (4, ""), (None, ITEM), (5, "one two three"), (6, changed(ITEM, [14])), (1, ITEM)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontamination.matches(docs, bench), "doc_id", "item_id", "n_item", "n_shared")
    assert got == sorted(brute.contained(TEXTS, items), key=repr)
    hit = {g[0] for g in got}
    left = decontamination.without_matches(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(d not in hit for d, _ in TEXTS)
    assert decontamination.matches(none, bench).collect() == []
    assert decontamination.without_matches(docs, bench.limit(0)).count() == len(TEXTS)


def test_items_inside_very_long_documents_are_found(spark):
    items = [(i, prose(12 + i % 40, 1000 + i)) for i in range(60)]
    texts = [(i, prose(6000, 2000 + i) + " " + items[i][1] + " " + prose(3000, 3000 + i)) for i in range(60)]
    a, b = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(a, b).collect()} == {(i, i) for i in range(60)}


def test_decontamination_and_quality_run_no_python(docs):
    for df in (decontamination.matches(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), quality_rules.judge(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_quality_counts_equal_brute_force(docs, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rows_of(quality_rules.judge(docs), "doc_id", *names)
    assert got == sorted(((d, *brute.quality_counts(t)) for d, t in TEXTS), key=repr)
    judged = quality_rules.judge(docs)
    assert judged.schema["kept"].dataType.simpleString() == "boolean"
    assert judged.filter("base_failed AND kept").count() == 0
    assert quality_rules.judge(none).collect() == []


def test_limits_adapt_to_the_group(spark):
    """A source whose documents all carry signs keeps them; the odd one of a plain source goes."""
    signed = lambda i: prose(60, i).replace(" ", "# ")
    rows = [(i, signed(i) if i % 2 else prose(60, i), "en", f"s{i % 2}") for i in range(500)]
    rows.append((1000, signed(1000), "en", "s0"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).select("doc_id", "kept").collect()}
    assert not got.pop(1000)
    assert all(got.values())


def test_repeats_equal_brute_force(docs, none):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = rows_of(suffix_dedup.dedup(docs), *names)
    assert got == sorted(brute.without_repeats(TEXTS), key=repr)
    assert suffix_dedup.dedup(none).collect() == []


def test_repeats_of_hot_grams_are_counted_window_by_window(spark):
    rows = [(i, prose(30, 500 + i) + " " + PASSAGE + " " + prose(30, 600 + i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = suffix_dedup.keyed_rows(df, "text", ["doc_id"])
    ids = {r._doc: r._p0 for r in keyed.collect()}
    for hot in (2, 4096):
        spans = suffix_dedup.repeated_spans(keyed, hot=hot)
        covered = {}
        for r in spans.collect():
            covered.setdefault(ids[r.doc], set()).update(range(r.first, r.last + suffix_dedup.LENGTH))
        assert {d: len(s) for d, s in covered.items()} == {d: n for d, _, n, _, _ in brute.without_repeats(rows) if n}


def test_long_rows_are_cut_into_stretches_without_loss(monkeypatch):
    raw = np.frombuffer((LONG + LONG[:5000]).encode(), dtype=np.uint8)
    borders = np.array([0, len(raw)])
    whole = [np.concatenate(c) for c in zip(*suffix_dedup.contexts(raw, borders))]
    covered = sum(whole[2])
    assert covered == len(raw) - suffix_dedup.LENGTH + 1
    monkeypatch.setattr(suffix_dedup.chunks, "__defaults__", (suffix_dedup.LENGTH, 5000))
    parts = [np.concatenate(c) for c in zip(*suffix_dedup.contexts(raw, borders))]
    assert sum(parts[2]) == covered
    assert set(parts[3].tolist()) == set(whole[3].tolist())


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"mississippi\0mississippi", bytes(range(256)) * 2, b"abab" * 30 + b"\xff\0"])
def test_two_stage_sorting_orders_suffixes(text):
    order = suffix_dedup.suffix_order(np.frombuffer(text, dtype=np.uint8))
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [text[i: i + suffix_dedup.LENGTH].ljust(suffix_dedup.LENGTH, b"\0") for i in order.tolist()]
    assert cut == sorted(cut)


def test_what_remains_of_a_text(docs):
    left = suffix_dedup.dedup(docs, keep_text=True)
    assert {c for c in docs.columns if c != "n_bytes"} <= set(left.columns)
    got = {r.doc_id: r.text for r in left.filter("doc_id in (6, 9, 14, 15)").collect()}
    assert got[6] is None
    assert got[9] == "one two three"
    assert got[14] == ""
    # The copy covers all but what follows it.
    assert got[15] == " tail"


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_encoded_as_whole_texts(ids):
    r = random.Random(9)
    pool = "ab é ß \t\n\r\x0b\x1c\x1f\x85\xa0  'sdtmlvre_09²½Ⅷ一あ́!#.,-\U0001F600\U00010330‍٠"
    texts = [t for _, t in TEXTS] + ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    encode = tokens.Encoder(tokens.vocabulary_path())
    assert all([*encode(t).tolist(), 0] == ids(t) for t in texts)


def test_added_tokens_in_a_text_are_encoded_as_the_library_does(ids):
    encode = tokens.Encoder(tokens.vocabulary_path())
    contents = [t.content for t in encode._library.get_added_tokens_decoder().values()]
    assert contents
    for c in contents:
        for text in (c, f"a {c} b", f"{c}{c}\n{BASE}", c[:-1], f"x{c}y \U0001F600"):
            assert [*encode(text).tolist(), 0] == ids(text)


def test_other_vocabularies_are_encoded_text_by_text():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert tokens.Encoder(path)("Hello there, World").tolist() == library.encode("Hello there, World", add_special_tokens=False).ids


def test_records_read_back_in_order(spark, docs, none, ids, tmp_path):
    out = str(tmp_path / "records")
    token_records.write_records(docs, out)
    index = token_records.read_index(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted([d for d, _ in TEXTS], key=lambda d: (d is not None, d))
    start = 0
    for r in index:
        assert r.start == start
        start += r.n_tokens
    expected = sorted((d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in TEXTS if d is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in index if r.doc_id is not None) == expected
    wanted = token_records.read_index(spark, out).filter("doc_id in (1, 6, 25)").orderBy(F.rand(3))
    got = {r.doc_id: r.ids for r in token_records.read_records(spark, out, wanted).collect()}
    assert got == {d: ids(dict(TEXTS)[d]) for d in (1, 6, 25)}
    token_records.write_records(none, str(tmp_path / "empty"))
    assert token_records.read_index(spark, str(tmp_path / "empty")).collect() == []


def test_damaged_records_are_refused():
    data = token_records.frame(b"payload--") + b"\n"
    assert [bytes(p) for _, p in token_records.frames_in(memoryview(data))] == [b"payload--"]
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames_in(memoryview(bytes(broken))))


def test_packing_places_every_piece_once(docs, none, ids):
    rows = packing.pack(docs, size=256).collect()
    texts = sorted((ids(t) for _, t in TEXTS), key=len)
    assert sum(r.length for r in rows) == sum(map(len, texts))
    assert sorted(r.ids_crc32 for r in rows if r.piece == 0 and r.length == 1) == sorted(
        zlib.crc32(np.array(t, "<u4").tobytes()) for t in texts if len(t) == 1)
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 256 or r.piece == 0
    for seat in seats.values():
        seat.sort()
        assert [o for o, _ in seat] == np.cumsum([0] + [n for _, n in seat])[:-1].tolist()
        assert sum(n for _, n in seat) <= 256
    assert len(seats) <= -(-sum(map(len, texts)) // 256) + 1
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_lower_bound_and_whole(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(2048, r.lognormal(5.5, 1.2, 60_000).astype(int) + 1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.plan_packing(histogram, 2048, rounds=60, rest=2000)
    last = {}
    for length, first, per, sequence, _ in runs.tolist():
        last.setdefault(length, []).append((first, per, sequence))
    sequences = 1 + max(int(s) for s in runs[:, 3])
    assert sequences <= 1.01 * -(-int(lengths.sum()) // 2048) + 1
    for length, parts in last.items():
        assert parts[0][0] == 0
        for (a, per, _), (b, _, _) in zip(parts, parts[1:]):
            assert (b - a) % per == 0


def test_packing_of_large_histograms_stays_small():
    runs = packing.plan_packing({n: 10**9 + n for n in range(1, 2049)}, 2048, rounds=40)
    total = sum(n * (10**9 + n) for n in range(1, 2049))
    assert len(runs) < 200_000
    assert runs[:, 3].max() <= 1.02 * total / 2048


@pytest.mark.parametrize("n", [150, 1200, 8000])
def test_small_tables_are_packed_by_configurations(n):
    r = np.random.default_rng(n)
    lengths = np.minimum(2047, r.lognormal(6, 0.8, n).astype(int) + 1)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    runs, by = packing.plan(histogram, 2048)
    assert by["configurations"] + by["best_fit"] == n
    assert by["best_fit"] <= len(histogram)
    assert by["configurations"] > (0.3 if n < 1000 else 0.45) * n
    assert 1 + runs[:, 3].max() <= 1.01 * -(-int(lengths.sum()) // 2048) + 1


def test_what_rounding_leaves_is_bounded_by_the_lengths():
    histogram = {n: 2_000_000 + 37 * n for n in range(40, 2048, 25)}
    runs, by = packing.plan(histogram, 2048)
    assert by["best_fit"] <= len(histogram)
    assert by["configurations"] + by["best_fit"] == sum(histogram.values())
    assert len(runs) < 50_000


def test_best_fit_by_runs_equals_best_fit_by_piece():
    r = random.Random(2)
    for _ in range(50):
        left = {r.randint(1, 100): r.randint(0, 9) for _ in range(12)}
        rooms = []
        for n in sorted(left, reverse=True):
            for _ in range(left[n]):
                at = min((k for k in range(len(rooms)) if rooms[k] >= n), key=rooms.__getitem__, default=None)
                if at is None:
                    rooms.append(100 - n)
                else:
                    rooms[at] -= n
        found = packing.best_fit(left, 100)
        assert sorted(100 - sum(n * k for n, k in c) for c, times in found for _ in range(times)) == sorted(rooms)
    assert sum(times for _, times in packing.best_fit({30: 10**9, 7: 10**9}, 100)) < 4 * 10**8


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet") if (TESTDATA := str(Path(sf).parent)) else None
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    r = found.filter(f"held_out <> (crc32(cast(doc_id as string)) % 3 = 1) OR score < 0 OR score > 1")
    assert r.count() == 0


def test_language_of_awkward_rows(docs, none):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert len(language_id.identify(docs).collect()) == len(TEXTS)
    assert got[6] == got[7] == got[8] == ("und", 0.0)
    assert got[1] == got[2]
    assert {p for p, _ in got.values()} <= {"en", "de", "und"}
    assert language_id.identify(none).collect() == []


def test_elastic_net_leaves_weights_at_zero():
    r = np.random.default_rng(0)
    rows = [(np.array([y, 2 + int(r.integers(0, 50))]), np.ones(2)) for y in (r.integers(0, 2, 400))]
    labels = np.array([int(i[0]) for i, _ in rows])
    w = linear.train(rows, labels, 2, 60, l1=1.0)
    assert (w[2:] == 0).mean() > 0.8
    assert (linear.logits(rows, w).argmax(axis=1) == labels).all()


def test_temperature_brings_down_false_confidence():
    r = np.random.default_rng(1)
    labels = r.integers(0, 2, 2000)
    right = r.random(2000) < 0.7
    scores = np.zeros((2000, 2))
    scores[np.arange(2000), np.where(right, labels, 1 - labels)] = 10
    p = linear.softmax(scores / linear.temperature(scores, labels)).max(axis=1).mean()
    assert abs(p - 0.7) < 0.03


INSULTS = ["grobnik", "vatzel", "drusho"]


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(40, seed * 1000 + i).split()
        toxic = i % 2
        if toxic:
            w[r.randrange(40)] = r.choice(INSULTS)
        rows.append((i, ". ".join(" ".join(w[k: k + 10]) for k in range(0, 40, 10)), toxic))
    return rows


def test_toxicity_tolerates_gaps_and_inserted_letters(spark):
    rows = toxic_rows(400, 3)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1002, "...")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (1000, None), (5, 1)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 403
    right = [got[d].predicted == y for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean(right) > 0.97
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert got[1000].score == got[1001].score == got[1002].score < 0.5
    model = toxicity.fit([(t, y) for _, t, y in rows])
    plain, bent = (
        model.score(toxicity.worst_words([f"{VOCABULARY[0]} {w} {VOCABULARY[1]}" for w in ws], model.table, model.bias, {}))
        for ws in (VOCABULARY[2:40], ["gro-bnik", "grobxnik", "vattzel", "v a t z e l", "dru.sho", "drusqho"]))
    assert bent.min() > plain.max()


def test_toxicity_without_evidence(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.classify(docs, labels).collect()} == {0.0}
    assert toxicity.classify(none, labels).collect() == []


def test_kernel_of_landmarks_equals_the_folded_weights():
    words = ["grobnik", "vatzel", "abc", "gro"]
    number, bucket, weight = toxicity.subsequences(["grobnik"])
    table = np.bincount(bucket, weight, minlength=1 << toxicity.BITS)
    assert np.allclose(toxicity.margins(words, table, 0.0), toxicity.kernel_with(words, ["grobnik"])[:, 0])
    assert abs(toxicity.kernel_with(["grobnik"], ["grobnik"])[0, 0] - 1) < 0.05


def test_signs_beyond_16_bits_are_no_letters():
    table = ngrams.letter_table()
    text = "\U0001F600 12 \U0001F680\U0001F680!"
    assert not (ngrams.letters_only(ngrams.code_points(text), table) != 32).any()
    # Gothic letters are letters.
    assert (ngrams.letters_only(ngrams.code_points("\U00010330\U00010331"), table) != 32).all()


def test_a_text_of_emoji_has_no_language(spark, docs):
    one = spark.createDataFrame([(1, "\U0001F600 42 \U0001F680"), (2, BASE)], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(one, language_id.fit(docs.select("text", F.lit("en").alias("lang")))).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"


def test_quality_views_teach_each_other(spark):
    rows = [(i, prose(40, i) if i % 2 else "### " + prose(5, i) + " $$$", "en", f"s{i % 2}", 200) for i in range(600)]
    docs = spark.createDataFrame(rows + [(900, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == 601
    unlabelled = range(120, 600)
    for column in ("text_score", "metadata_score", "score"):
        assert np.mean([(got[i][column] >= 0.5) == bool(i % 2) for i in unlabelled]) > 0.97
    empty = labels.limit(0)
    assert {r.score for r in quality_classifier.classify(docs, empty).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []


def test_licenses_and_their_wording(spark, none):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Licensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "released under MIT License"), (5, "The driver has a license to drive."), (6, None), (7, ""), (8, prose(5000, 70)),
        (9, "All rights reserved.\n" + prose(20, 71) + "\nReleased under the MIT License."), (None, "All rights reserved."),
        (2, "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, license string")
    found = license_scan.scan(df).collect()
    got = sorted(((r.doc_id, r.line, r.license, r.n_different) for r in found), key=repr)
    assert got == sorted([
        (1, 1, "Apache-2.0", 0), (2, 0, "CC-BY-NC-4.0", 0), (2, 0, "CC-BY-NC-4.0", 0), (3, 0, "GPL-2.0", 0), (4, 0, "MIT", 1),
        (9, 0, "MIT", 0), (9, 0, "all-rights-reserved", 0), (None, 0, "all-rights-reserved", 0)], key=repr)
    assert next(r.missing_words for r in found if r.doc_id == 4) == "the"
    # A block of several notices and other words saves less with each template.
    assert all(r.saving > (0 if r.doc_id == 9 else 0.15) for r in found)
    assert license_scan.scan(none).collect() == []


def test_every_notice_of_a_long_block_is_confirmed(spark):
    notices = {}
    for name, body, _ in license_scan.TEMPLATES:
        notices.setdefault(name, body)
    block = "\n".join(notices.values())
    line = prose(15_000, 80) + " All rights reserved. " + prose(15_000, 81)
    near = prose(1_500, 82) + " released under MIT License " + prose(1_500, 83) + " under the " + prose(50, 84)
    df = spark.createDataFrame([(1, block), (2, line), (3, near)], "doc_id bigint, text string")
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    assert set(got[1]) == set(notices)
    assert set(got[2]) == {"all-rights-reserved"} and got[2]["all-rights-reserved"].n_different == 0
    assert set(got[3]) == {"MIT"} and got[3]["MIT"].n_different == 1


def test_license_candidates_equal_an_exhaustive_comparison(spark, sf):
    """Every block of real rows against every template, without the ranking."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.line, r.license) for r in license_scan.scan(docs).collect()}
    import re

    expected = set()
    for r in docs.collect():
        for line, block in license_scan.blocks_of(r.text or "", re.compile(license_scan.CUE)):
            inside = license_scan.normal_words(block)
            for name, body, telling in license_scan.TEMPLATES:
                words, must = license_scan.normal_words(body), set(telling.split())
                n, missing, _ = license_scan.differences(words, inside)
                if n <= 0.2 * len(words) and must <= set(inside) and not must & set(missing):
                    expected.add((r.doc_id, line, name))
    assert got == expected
