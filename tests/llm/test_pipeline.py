import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from curadrift.llm import jaccard, language, repeats, surrogates
from test_jaccard import brute as near_brute
from test_repeats import passage_brute


def prose(rng, n):
    return " ".join(rng.choice(["ba", "ko", "lim", "tesu", "nor", "quat", "vel", "zi"]) + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))


def fixture():
    rng = random.Random(4)
    passage = prose(rng, 120)
    rows = [(i, prose(rng, 60) + f" mail person{i}@corp.com", "aa", "s1", 0) for i in range(20)]
    rows += [(20 + i, rows[i][1] + " extra", "aa", "s2", 0) for i in range(5)]
    rows += [(40 + i, prose(rng, 50) + " " + passage + " " + prose(rng, 50), "aa", "s3", 0) for i in range(4)]
    rows += [(60, None, "aa", "s", None), (61, "", None, "s", 0), (62, "12 34 !!", "aa", "s", 8), (None, prose(rng, 30), None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows] + [rows[0]]


def test_every_stage_against_brute_force(spark, small_sf):
    schema = spark.read.parquet(f"{small_sf}/documents.parquet").schema
    docs = spark.createDataFrame(fixture(), schema)
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "jaccard_join", "suffix_dedup", "surrogates", "packing"]
    first = C.in_a_language(spark, docs, small_sf)
    assert first.columns == docs.columns
    rows = first.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in fixture() if r[0] not in (60, 61, 62))
    second = C.one_of_near_copies(spark, first, small_sf)
    keep = second.collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = near_brute([r.text for r in order])
    want = {}
    for r, (group, _, _) in zip(order, groups, strict=True):
        want.setdefault(group, r.doc_id)
    assert second.columns == docs.columns and sorted(map(str, want.values())) == sorted(str(r.doc_id) for r in keep)
    third = {r.doc_id: r for r in C.repeated_passages_cut(spark, second, small_sf).collect()}
    passages = passage_brute([r.text for r in keep], repeats.PASSAGE)
    for r, runs in zip(keep, passages, strict=True):
        assert len(third[r.doc_id].text.encode()) == len(r.text.encode()) - sum(e - s for s, e in runs)
        assert third[r.doc_id].n_chars == len(third[r.doc_id].text)
    assert any(passages)
    fourth = C.private_data_replaced(spark, spark.createDataFrame(list(third.values()), schema), small_sf)
    assert fourth.columns == docs.columns
    texts = [r.text for r in fourth.collect()]
    assert len(texts) == len(third) and not any("@corp.com" in t for t in texts) and sum(".example" in t for t in texts) == 20


def test_run_gives_pieces_of_what_was_kept(spark, small_sf):
    pieces = C.run(spark, small_sf)
    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    kept = pieces.select("doc_id").distinct()
    assert 0 < kept.count() <= docs.count() and kept.join(docs, "doc_id", "left_anti").count() == 0
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_table(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").where("false")
    for name, stage in C.STAGES:
        out = stage(spark, docs, small_sf)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_extra_columns_with_clashing_names(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").limit(30)
    for name in ("row", "key", "spans", "text_id", "mark", "entities", "p", "drawn", "kinds", "nth", "entities_found", "group_id", "set_id"):
        docs = docs.withColumn(name, F.lit(1))
    for out in (language.in_a_language(docs), jaccard.one_of_each(docs), repeats.without_repeats(docs), surrogates.without_private_data(docs)):
        assert out.columns == docs.columns and out.agg(F.sum("key"), F.sum("row")).first()[0] > 0
    assert C.packed(spark, docs, small_sf).count() > 0
