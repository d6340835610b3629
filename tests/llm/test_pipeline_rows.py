"""The pipeline's stages on rows with null, repeated and clashing ids, empty texts and empty tables."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}x" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0 if t is None else len(t)) for d, t, s in rows], SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([("q", prose(99, 30)), (None, prose(98, 30)), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_go_by_text_not_by_id(spark, folder):
    a, b, c, d = (prose(i) for i in range(4))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(5, a, "s"), (5, b, "s"), (7, near, "t"), (None, a, "s"), (None, c, "s"), (None, d, None), (8, c.upper(), "s"), (9, None, "s"), (10, "", "s"), (5, b, "s")]
    got = pairs(corpus_pipeline.deduplicate(spark, frame(spark, rows), folder))
    assert got == sorted([(5, a), (5, b), (8, c.upper()), (None, d), (9, None), (10, "")], key=str)


def test_contaminated_rows_go_and_others_of_their_id_stay(spark, folder):
    bad, good = prose(99, 30), prose(5)
    rows = [(1, bad, "s"), (1, good, "s"), (None, "so " + bad, "s"), (None, good, "s"), (2, None, "s"), (2, "", "s"), (3, good, "s"), (3, good, "s")]
    got = pairs(corpus_pipeline.remove_contaminated(spark, frame(spark, rows), folder))
    assert got == sorted([(1, good), (None, good), (2, None), (2, ""), (3, good), (3, good)], key=str)


def test_secrets_and_language_keep_rows_apart(spark, folder):
    rows = [(1, "password = hunter2hunter2", "s"), (1, "nothing here", "s"), (None, None, "s"), (None, "token: abcdefgh12", "s"), (4, "123", "s")]
    got = pairs(corpus_pipeline.redact_secrets(spark, frame(spark, rows), folder))
    assert got == sorted([(1, "[ASSIGN]"), (1, "nothing here"), (None, None), (None, "[ASSIGN]"), (4, "123")], key=str)
    kept = pairs(corpus_pipeline.identify_language(spark, frame(spark, [(i, prose(i), "s") for i in range(30)] + rows), folder))
    assert (4, "123") not in kept and (None, None) not in kept and len(kept) == 33


def test_mixture_keeps_every_taken_row_once(spark, folder):
    rows = [(1, prose(1), "s"), (1, prose(2), "s"), (None, prose(3), "s"), (None, prose(3), "s"), (None, prose(4), None), (6, None, "s"), (7, "", "t"), (1, prose(1), "s")]
    got = corpus_pipeline.mix_sources(spark, frame(spark, rows), folder).collect()
    # one and a half times all words, each source at most twice: all rows with words are taken
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((d, t) for d, t, _ in rows if t), key=str)
    assert sum(r.taken for r in got) <= 1.5 * 6 * 60 and all(r.taken == r.copies * r.n_words for r in got)


def test_stages_on_an_empty_table(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame(spark, []), folder)
        assert set(corpus_pipeline.COLUMNS) <= set(got.columns) and got.count() == 0
