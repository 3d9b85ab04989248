"""Rows without ids or with repeated ones, and columns whose names clash with those used inside."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from lintharbor.llm import decontamination, ngram_join, quality_rules, suffix_dedup, toxicity  # noqa: E402

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE, ITEM = prose(60, 1), prose(30, 2)


def test_repeats_of_two_thousand_rows_without_an_id(spark):
    """Rows of different lengths, all without an id: each loses its own bytes."""
    rows = [(None, prose(i % 50, i) + (" " + PASSAGE if i % 9 == 0 else "") + prose(i % 30, -i)) for i in range(2000)]
    rows += [(7, prose(40, 9000 + i) + PASSAGE) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute.without_repeats(rows), key=repr)


def test_columns_of_any_name_survive(spark):
    names = ["_t", "_doc", "_salt", "_spans", "limits", "n_lines", "_w", "_l", "_s", "_p0", "_text", "body.x", "gram", "_h", "_k", "_c"]
    rows = [(i, prose(30, 100 + i) + PASSAGE, "en", "s", *[f"{n}{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    expected = {i: tuple(f"{n}{i}" for n in names) for i in range(30)}
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    for out in (suffix_dedup.dedup(df), suffix_dedup.dedup(df, keep_text=True), quality_rules.judge(df),
                decontamination.without_matches(df, bench), ngram_join.one_per_group(df)):
        assert {r.doc_id: tuple(r[n] for n in names) for r in out.collect()} == expected
    assert set(quality_rules.judge(df, keep=["doc_id"]).columns) == {"doc_id", *quality_rules.OUTPUT}


def test_each_row_is_judged_by_its_own_text(spark):
    held = prose(20, 31) + " " + ITEM + " " + prose(20, 32)
    rows = [(None, held), (None, prose(50, 33)), (5, held), (5, prose(50, 34)), (6, None), (7, "")]
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    left = decontamination.without_matches(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        (d or 0, t or "") for d, t in rows if t != held)


def test_unlike_documents_that_share_an_id_stay(spark):
    base = prose(100, 40)
    near = base.replace(base.split()[50], "other")
    rows = [(1, base), (1, prose(100, 41)), (2, near), (2, prose(100, 42)), (2, near), (3, prose(100, 42)), (4, ""), (4, None), (None, base)]
    left = ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        (d or 0, t or "") for d, t in [(1, base), (1, prose(100, 41)), (2, prose(100, 42)), (4, ""), (4, None), (None, base)])


def test_toxicity_learns_from_few_documents(spark, sf):
    """Ten toxic documents, in four languages: real scores, and half of those documents found."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("toxic IS NOT NULL").collect()
    assert len({round(r.score, 6) for r in rows}) > 20
    found = [r.predicted for r in rows if r.toxic == 1]
    assert sum(found) >= 0.5 * len(found)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.06 * sum(r.toxic == 0 for r in rows)


def test_copies_do_not_crowd_out_the_sample(spark):
    r = random.Random(3)
    insults = ["grobnik", "vatzel", "drusho"]
    rows = [(i, prose(40, 500 + i) + (". you " + r.choice(insults) + " and " + r.choice(insults) if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(300)]
    rows += [(1000 + i, rows[1][1], 0) for i in range(3000)] + [(1000, "again", 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.classify(docs, labels).collect()}
    assert sum(got[d] == y for d, _, y in rows[:300]) >= 0.97 * 300


def test_words_beyond_chance_scale_with_the_sample():
    from collections import Counter

    few = toxicity.telling_words({1: Counter(bad=6, once=1, common=8), 0: Counter(common=50)}, Counter({0: 60, 1: 10}))
    assert set(few) == {"bad"}
    many = toxicity.telling_words({1: Counter(bad=60, chance=9, common=500), 0: Counter(chance=55, common=3000)}, Counter({0: 3000, 1: 500}))
    assert set(many) == {"bad"}
