import itertools
import zlib

import numpy as np
import pytest

from curadrift.llm import language as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double, row int"


def test_held_out_rule(spark):
    docs = spark.createDataFrame([(i, "", None, "", 0.0, 0) for i in (0, 1, 7, 12, 345, -3, None)], SCHEMA)
    got = {r.doc_id: r.held_out for r in L.identified(docs).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False for i in (0, 1, 7, 12, 345, -3, None)}


def test_posteriors_against_all_paths():
    rng = np.random.default_rng(0)
    field = L.Field(["a", "b", "c"], {})
    field.transitions = rng.dirichlet([1, 1, 1], 3)
    sizes = np.array([1, 4, 3, 5, 4])
    chances = rng.random((sizes.sum(), 3)) + 0.05
    got, seen = field.posteriors(chances, sizes, pairs=True)
    at, joint = 0, np.zeros((3, 3))
    for n in sizes:
        want, pairs, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = field.start[path[0]] * np.prod([chances[at + t, k] for t, k in enumerate(path)])
            p *= np.prod([field.transitions[a, b] for a, b in itertools.pairwise(path)])
            total += p
            for t, k in enumerate(path):
                want[t, k] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        assert np.allclose(got[at:at + n], want / total)
        joint += pairs / total
        at += n
    assert np.allclose(seen, joint)


def test_held_out_accuracy_and_score_range(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == docs.count() and len(unseen) > 200
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def field():
    en = "the cat sat on the mat and then it was the end of this story with some more words"
    de = "die katze sitzt auf der matte und dann war es das ende der geschichte mit noch mehr worten"
    return L.fitted([(en, "en"), (de, "de")] * 20)


def test_words_of_a_mixed_text_are_labelled_apart(field):
    words = L.words_of("the cat sat on the mat and then die katze sitzt auf der matte und dann")
    chances = L.chances_of(field.emissions(*L.features(words, field.lexicon)))
    labels = [field.labels[k] for k in field.posteriors(chances, np.array([len(words)])).argmax(axis=1)]
    assert labels == ["en"] * 8 + ["de"] * 8


def test_edge_texts(field, monkeypatch):
    texts = [None, "", "123 !!", "the", "THE END", "katze " * 30_000, "x" * 100_000, "the cat"]
    got = L.predictions(texts, field)
    assert got[:3] == [("und", 0.0)] * 3 and got[4][0] == "en" and got[5][0] == "de" and got[6][0] in ("en", "de")
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 1)
    for (a, x), (b, y) in zip(got, L.predictions(texts, field)):
        assert a == b and abs(x - y) < 1e-9


def test_rejecting_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5), (None, "", None, None, None)], docs.schema)
    out = L.in_a_language(docs.union(extra))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {-1, -2, None} and len(kept) >= docs.count() - 2


def test_no_labels_and_empty_table(spark):
    rows = L.identified(spark.createDataFrame([(1, "some text", None, "", 0.0, 0)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert L.identified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_in_three_languages_stays(spark):
    en = "the cat sat on the mat and then it was the end of this story with some more words"
    de = "die katze sitzt auf der matte und dann war es das ende der geschichte mit noch mehr worten"
    ru = "кошка сидела на коврике и потом это был конец этой истории где было ещё несколько разных слов"
    mixed = " ".join(" ".join(t.split()[:15]) for t in (en, de, ru))
    labelled = [(i, t, lang, "", 0.0, i) for lang, t, base in (("en", en, 0), ("de", de, 100), ("ru", ru, 200)) for i in range(base, base + 30)]
    docs = spark.createDataFrame(labelled + [(-1, mixed, None, "", 0.0, 0), (-2, "12 34", None, "", 0.0, 0)], SCHEMA)
    assert {r.doc_id: r.score for r in L.identified(docs).collect()}[-1] < L.MIN_SCORE
    assert {r.doc_id for r in L.in_a_language(docs).collect()} == {r[0] for r in labelled} | {-1}


def test_numeric_signs_are_no_letters(field):
    got = L.predictions(["½ ² ① Ⅷ", "Ⅷ", "² the cat", "½"], field)
    assert [got[i] for i in (0, 1, 3)] == [("und", 0.0)] * 3 and got[2][0] == "en"
