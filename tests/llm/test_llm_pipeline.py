"""The pipeline's stages against brute force, and what they keep."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    """Rows of each stage at the small scale, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_stay_until_the_last_stage(results):
    for _, df in results[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_quality_drops_what_the_base_rule_refuses(results):
    before, after = pairs(results[0][1]), dict(pairs(results[1][1]))
    assert not any(brute.quality_counts(t)[-1] for t in after.values())
    assert len(after) > 0.8 * sum(not brute.quality_counts(t)[-1] for _, t in before)


def test_one_of_each_group_stays(results):
    before, after = pairs(results[1][1]), pairs(results[2][1])
    assert [d for d, _ in after] == [d for d, _, c in brute.components(before) if d == c]


def test_repeated_passages_are_cut(results):
    before, after = pairs(results[2][1]), pairs(results[3][1])
    assert [d for d, _ in after] == [d for d, _ in before]
    for (d, n, gone, _, _), (_, text) in zip(brute.without_repeats(before), after):
        assert n - gone - 8 <= len(text.encode()) <= n - gone


def test_documents_with_items_go(spark, sf, results):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = pairs(results[3][1]), pairs(results[4][1])
    hit = {d for d, *_ in brute.contained(before, items)}
    assert [d for d, _ in after] == [d for d, _ in before if d not in hit]


def test_all_that_is_left_is_packed(results):
    left, packed = results[4][1], results[5][1]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}


def test_stages_take_awkward_rows(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, token string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y"), (1, "a b " * 30, None, "s", 120, "x", "y")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= len(rows)
