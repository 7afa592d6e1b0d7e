import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curadrift.llm import packing as P, vocab

SCHEMA = "doc_id long, text string, ids string, curve int, row_no string"
PATH = vocab.vocabulary_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))


def check_pieces(rows, texts, tokenizer, size):
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[doc])
            ids = want[doc][at:at + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += p.length
        assert at == len(want[doc])
    padding = 0
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_pieces_cover_every_id_once(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "TOKENS_PER_PART", 500)
    texts = ["", None, "a", "one two three " * 400, "  ", "é\n\n\t x" * 50, "<|endoftext|>a <|endoftext|>", "it's 12 o'clock!!"] + ["same text here"] * 40
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    check_pieces(P.packed(docs, PATH, 64).collect(), texts, tokenizer, 64)


def test_ids_come_with_the_pieces(spark):
    docs = spark.createDataFrame([(1, "hello world", "", 0, "")], SCHEMA)
    got = sorted(P.packed(docs, PATH, 8).collect(), key=lambda r: r.start)
    assert sum([r.ids for r in got], []) == [31373, 995, 1]


def test_whole_table(spark, small_sf, tokenizer):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = P.packed(docs, PATH, with_ids=False).collect()
    place = {d: i for i, d in enumerate(ids)}
    rows = [type(r)(**{**r.asDict(), "doc_id": place[r.doc_id]}) for r in rows]
    check_pieces(rows, texts, tokenizer, P.SIZE)


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", "", 0, ""), (None, "a b c", "", 0, ""), (3, "d", "", 0, "")], SCHEMA)
    rows = P.packed(docs, PATH).collect()
    assert sum(r.length for r in rows) == 4 + 4 + 2 and len({r.row_no for r in rows}) == 3


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_keys_visit_neighbours(dims):
    bits = 3
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = P.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_lie_close(spark):
    texts = [("alpha beta gamma " if i % 2 else "un deux trois quatre ") * (5 + i % 7) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "", 0, "") for i, t in enumerate(texts)], SCHEMA)
    rows = P.packed(docs, PATH).groupBy("doc_id").agg(F.min(F.struct("sequence_id", "offset")).alias("at")).orderBy("at").collect()
    kinds = [r.doc_id % 2 for r in rows]
    assert sum(a != b for a, b in itertools.pairwise(kinds)) <= 8
