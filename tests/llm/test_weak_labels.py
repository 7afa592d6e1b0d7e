import numpy as np

from curadrift.llm import quality as Q

SCHEMA = "doc_id long, text string, junk int, j string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def test_expectation_maximisation_finds_the_rates():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.15
    want = np.array([[[0.95, 0.03, 0.02], [0.2, 0.75, 0.05]], [[0.9, 0.05, 0.05], [0.4, 0.5, 0.1]], [[0.5, 0.01, 0.49], [0.05, 0.45, 0.5]],
                     [[0.97, 0.02, 0.01], [0.3, 0.65, 0.05]]])
    votes = np.stack([[rng.choice(3, p=want[n, int(t)]) for t in truth] for n in range(4)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rates = Q.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - truth.mean()) < 0.02 and np.abs(rates - want).max() < 0.06
    assert ((Q.posterior(votes, prior, rates) > 0.5) == truth).mean() > 0.97


def test_codes_keep_the_votes():
    found = {"repetition": np.array([0, 1, 2]), "symbols": np.array([2, 2, 1])}
    back = Q.decoded(Q._coded(found, Q.JUNK), Q.JUNK)
    assert back[:, 0].tolist() == [0, 1, 2] and back[:, 1].tolist() == [2, 2, 1] and (back[:, 2:] == Q.SILENT).all()


def test_shape_of_texts():
    shape = Q.Reading(["a a a b", "", "x!! y## | |", "AB CD ef"]).shape()
    assert shape["repeated"].tolist() == [0.5, 0, 0.25, 0] and shape["variety"].tolist() == [0.5, 0, 0.75, 1]
    assert shape["symbols"].tolist() == [0, 0, 0.5, 0][:4] or shape["symbols"][2] == 0.5
    assert shape["bars"][2] == 0.5 and abs(shape["capitals"][3] - 2 / 3) < 1e-9


def test_planted_toxic_and_junk_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    unseen = labels.where("doc_id % 4 = 0")
    got = Q.judged(docs, labels.where("doc_id % 4 <> 0")).join(unseen.withColumnRenamed("toxic", "was_toxic"), "doc_id").collect()
    assert len(got) > 500
    toxic, clean = [r.toxic for r in got if r.was_toxic], [r.toxic for r in got if not r.was_toxic]
    assert np.mean(np.array(toxic) >= Q.TOXIC_LIMIT) > 0.8 and np.mean(np.array(clean) >= Q.TOXIC_LIMIT) < 0.01
    assert np.mean([r.junk > 0.5 for r in got if r.quality]) < 0.03 and np.mean([r.junk > 0.5 for r in got if not r.quality]) > 0.6


def test_no_labels_nulls_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1, "", ""), (None, "a b c", 1, "", ""), (None, "a b c", 1, "", ""), (2, "x " * 100_000, 1, "", ""), (3, "", 1, "", "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    rows = Q.judged(docs, none).collect()
    assert len(rows) == 5 and all(0 <= r.junk <= 1 and 0 <= r.toxic <= 1 for r in rows)
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 0, 1), (2, 0, 1), (9, 1, 1)], LABELS)
    assert Q.judged(docs, odd).count() == 5
    assert Q.judged(docs.where("false"), odd).collect() == []
