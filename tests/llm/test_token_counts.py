import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st

from curadrift.llm import token_counts as C, vocab

PATH = vocab.vocabulary_path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_bytes int, n_tokens string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.vocabulary_path("byte_bpe_50k.json"))


def want(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "", " ", "   ", "\n", " \n ", "a", "it's we're they'll I'd 'st !'s 's's ''re", "x  y   z \t w\n\n  q", "12ab34 ½ Ⅷ ٣", "日本語 text ελληνικά é é",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " x  y　", "\x1c\x1d a \x85b", "🎉🎉👩‍👩‍👧 !!", "a" * 5000, "ab " * 3000,
    "\0\0 \0", "Ünïcödé'S 'S", " '", "' ", "'", "''''''", "don't  'll",
]


def test_against_the_library(tokenizer):
    assert C.counts(TEXTS, PATH).tolist() == want(tokenizer, TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aestrvlmd' \n\t.!1 é"), st.characters(blacklist_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_against_the_library_on_made_up_texts(tokenizer, texts):
    assert C.counts(texts, PATH).tolist() == want(tokenizer, texts)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunk_maps_give_the_pattern_s_pieces(chunk):
    import public_tokenizers

    rng = random.Random(chunk)
    text = "".join(rng.choice("ab1 \n'stre!é\t") for _ in range(3000))
    codes = np.frombuffer((text + "\0").encode("utf-32-le"), dtype=np.uint32)
    ends = np.zeros(len(codes), dtype=bool)
    ends[-1] = True
    got = np.flatnonzero(C.piece_begins(C.classes_of(codes, ends), chunk))
    assert got.tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_states_may_be_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(C, "MOST_STATES", 50)
    monkeypatch.setattr(C, "MOST_PIECES", 10)
    assert C.counts(TEXTS, PATH).tolist() == want(tokenizer, TEXTS)


def test_whole_table(spark, tokenizer, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in C.token_counts(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for (doc_id, text), n in zip(texts.items(), want(tokenizer, list(texts.values())), strict=True):
        r = rows[doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024)


def test_nulls_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (None, "a b", 1, "x"), (None, "a b", 1, "x")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(docs, PATH).collect())
    assert got == [(0, 3, 2, False), (0, 3, 2, False), (1, 0, 0, False)]
    assert C.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []
