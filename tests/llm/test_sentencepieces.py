import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from curadrift.llm import sentencepieces as S, vocab

PATH = vocab.vocabulary_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_pieces int"
TEXTS = [
    "", " ", "  ", "a", "Hello  world", " lead", "trail ", "a\n\n b\t\tc\r\n", "é日本𝄞 👩‍👩‍👧", "▁x ▁▁y", "<s>hi</s><unk><0x0A>", "\0 \0\0",
    "   日", "x" + " " * 40 + "y", " " * 37, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization " * 30, "don't stop; e.g. 3.14159", "ﬁ Å　x",
    "thethethethe onononon ingining", "a" * 3000, "日" * 500, "\x1b[0m",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_against_the_library(library, monkeypatch):
    got = [i.tolist() for i in S.encode(TEXTS, PATH)]
    assert got == library.encode(TEXTS)
    pieces = S.pieces_of(PATH)
    assert [pieces.decode(i) for i in got] == [library.decode(i) for i in got]
    monkeypatch.setattr(S, "INDEXED_AT_ONCE", 20)
    assert [i.tolist() for i in S.encode(TEXTS, PATH)] == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("theonigra  \n,.é"), st.characters(blacklist_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_against_the_library_on_made_up_texts(library, texts):
    assert [i.tolist() for i in S.encode(texts, PATH)] == library.encode(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_decoding_any_ids(library, ids):
    ids = [i for i in ids if i > 2]
    assert S.pieces_of(PATH).decode(ids) == library.decode(ids)


@pytest.mark.parametrize("count", [*range(1, 40), 100, 333])
def test_white_space_alone(library, count):
    assert list(S.pieces_of(PATH).run(count + 1)) == library.encode(" " * count)


def test_occurrences_against_a_scan():
    pieces = S.pieces_of(PATH)
    text = "▁the▁nation▁of▁nations"
    codes = np.array([ord(c) for c in text])
    at, row = S.occurrences(S.suffixes(np.unique(codes, return_inverse=True)[1], pieces.longest), codes, pieces)
    names = {n: t for t, n in pieces.rule.number.items()}
    got = sorted((a, names[pieces.numbers[r]]) for a, r in zip(at.tolist(), row.tolist()))
    assert got == sorted((i, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in pieces.rule.number)


@pytest.fixture()
def fresh():
    """The vocabulary with no words or pairs held."""
    S.pieces_of.cache_clear()
    yield S.pieces_of(PATH)
    S.pieces_of.cache_clear()


def test_common_words_are_indexed_once(library, fresh, monkeypatch):
    indexed = []
    encode_units = S.encode_units
    monkeypatch.setattr(S, "encode_units", lambda units, pieces: indexed.extend(units) or encode_units(units, pieces))
    monkeypatch.setattr(S, "HELD_WORDS", 8)
    for turn in range(20):
        texts = ["the nation  of the nation", " ".join(f"rare{turn}x{n}" for n in range(10))]
        assert [i.tolist() for i in S.encode(texts, PATH)] == library.encode(texts)
    assert indexed.count("▁the") == indexed.count("▁nation") == 1
    assert indexed.count("▁rare3x3") == 1


def test_pairs_are_replayed_once(fresh, monkeypatch):
    asked = []
    fit = fresh.rule.fit
    monkeypatch.setattr(fresh.rule, "fit", lambda a, b: asked.append(len(a)) or fit(a, b))
    units = [f"▁internationalization{n}" for n in range(200)]
    first = S.encode_units(units, fresh)
    before = sum(asked)
    again = S.encode_units(units, fresh)
    assert 0 <= sum(asked) - before < before / 10
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


def test_pairs_that_share_a_place(library, fresh, monkeypatch):
    monkeypatch.setattr(S, "HELD_PAIRS", 2)
    fresh.pairs = fresh.pairs[:2].copy()
    assert [i.tolist() for i in S.encode(TEXTS, PATH)] == library.encode(TEXTS)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("then  ion日𝄞"), max_size=30), max_size=4), min_size=1, max_size=8), st.integers(0, 6), st.integers(0, 40))
def test_held_words_are_bounded_and_right(library, texts, words, chars):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "HELD_WORDS", words)
        patch.setattr(S, "HELD_CHARS", chars)
        held = S.Held()
        patch.setattr(S.pieces_of(PATH), "held", held)
        for batch in texts:
            assert [i.tolist() for i in S.encode(batch, PATH)] == library.encode(batch)
            held.trim()
            assert len(held.number) == len(held.sizes) <= words and held.chars == sum(map(len, held.number)) <= chars


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6), st.integers(1, 20), st.sampled_from([1, 5000, 1 << 20]))
def test_suffixes_of_words_against_a_sort(words, depth, spread):
    end = 3 * spread + 1
    symbols = [x * spread for w in words for x in [*w, end / spread]]
    room = [len(w) - n for w in words for n in range(len(w) + 1)]
    got = S.suffixes(np.array(symbols, dtype=np.int64), depth, np.array(room))
    seen = [symbols[i:i + min(depth, room[i] + 1)] for i in got.tolist()]
    assert sorted(got.tolist()) == list(range(len(symbols))) and seen == sorted(seen)
    whole = [symbols[i:i + depth] for i in S.suffixes(np.array(symbols, dtype=np.int64), depth).tolist()]
    assert whole == sorted(whole)


def test_ordering_of_small_and_large_keys():
    for top in (5, 1 << 62):
        keys = np.array([top, 0, 3, top, 3, 0], dtype=np.int64)
        order, values = S.ordering(keys)
        assert order.tolist() == [1, 5, 2, 4, 0, 3] and (values == keys[order]).all()
    assert [len(x) for x in S.ordering(np.zeros(0, dtype=np.int64))] == [0, 0]


def test_whole_table_and_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.encoding_report(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), True)
    small = docs.limit(40)
    back = {r.doc_id: r.text for r in S.decoded(S.encoded(small, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text for r in small.collect()}


def test_nulls_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (None, "a b", "x", 1), (None, "a b", "x", 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_pieces, r.round_trip) for r in S.encoding_report(docs, PATH).collect())
    assert got == [(0, 2, True), (0, 2, True), (1, 0, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert S.encoding_report(empty, PATH).collect() == [] and S.encoded(empty, PATH).collect() == []
