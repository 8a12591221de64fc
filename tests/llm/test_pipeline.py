"""Stages of the corpus pipeline on small tables: shared ids, repeats, nulls, empty tables, clashing columns."""

import collections

import pytest

import corpus_pipeline as cp
from latencylab.llm import langid

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
A = "The quick brown fox jumps over the lazy dog near the river bank and then it sleeps under the old oak tree until morning comes again today"
B = "Completely different words about cooking pasta with tomatoes garlic basil olive oil and a pinch of salt served hot on large white plates"


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], columns)


def ids_and_texts(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_other_texts_of_an_id_that_goes_stay(spark):
    docs = table(spark, [(1, A, "en", "s"), (2, A, "en", "s"), (2, B, "en", "s")])
    assert ids_and_texts(cp.keep_first_of_group(spark, docs, "")) == {(1, A): 1, (2, B): 1}


def test_rows_listed_again_stay_once(spark):
    rows = [(1, A, "en", "s2"), (1, A, "en", "s1"), (1, A, "en", "s1"), (4, B, None, None), (4, B, None, None)]
    got = cp.keep_first_of_group(spark, table(spark, rows), "")
    assert ids_and_texts(got) == {(1, A): 1, (4, B): 1}
    assert {r["source"] for r in got.collect()} == {"s1", None} and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_missing_ids_and_texts(spark):
    rows = [(None, A, "en", "s"), (7, A, "en", "s"), (None, B, "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (None, None, "en", "s")]
    got = ids_and_texts(cp.keep_first_of_group(spark, table(spark, rows), ""))
    assert got == {(7, A): 1, (None, B): 1, (5, None): 1}  # texts without words are alike


def test_near_copies_against_all_pairs(spark):
    from tests.llm.test_dedup import groups, plain_fingerprint

    texts = [A, A + " x", B, B.upper(), A + " and more words here to change it quite a lot as well", "short", "short one", ""]
    rows = [(10 - i, t, "en", "s") for i, t in enumerate(texts)]
    root = groups([plain_fingerprint(t) for t in texts])
    expected = {}
    for i, t, *_ in rows:
        g = root[plain_fingerprint(t)]
        expected[g] = min(expected.get(g, 99), i)
    got = cp.keep_first_of_group(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(expected.values())


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:3]])
def test_empty_tables_and_further_columns(spark, stage):
    kind = COLUMNS + ", id string, row string, key string, tag int, kept int"
    empty = spark.createDataFrame([], kind)
    got = stage(spark, empty, "")
    assert got.columns == empty.columns and got.count() == 0
    one = spark.createDataFrame([(1, A, "en", "s", len(A), "i", "r", "k", 3, 4), (None, None, None, None, None, None, None, None, None, None)], kind)
    assert stage(spark, one, "").columns == one.columns


def test_whole_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = cp.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    stages = docs
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, stages, sf_dir)
        assert kept.columns == docs.columns
        before, after = (collections.Counter(r["doc_id"] for r in x.select("doc_id").collect()) for x in (stages, kept))
        assert not after - before  # a stage invents nothing
        stages = kept.checkpoint() if spark.sparkContext.getCheckpointDir() else kept.cache()
    assert sorted(r["doc_id"] for r in stages.select("doc_id").collect()) == sorted(ids)


def test_language_sample_is_bounded_for_an_id_with_many_texts(spark):
    rows = [(7, f"the people of the town number {i}", "en") for i in range(3000)] + [(7, "again and again", "en")] * 500
    rows += [(i, f"les gens de la ville {i}", "fr") for i in range(300)]
    found = langid.sample(spark.createDataFrame(rows, "id bigint, text string, lang string"), 100, 10_000_000).collect()
    n = collections.Counter(r["lang"] for r in found)
    assert all(60 < n[lang] < 145 for lang in ("en", "fr")) and len({(r["id"], r["text"]) for r in found}) == len(found)
    few = langid.sample(spark.createDataFrame(rows, "id bigint, text string, lang string"), 1000, 900).collect()
    assert sum(len(r["text"]) for r in few if r["lang"] == "fr") < 1800
