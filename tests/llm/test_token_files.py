import io
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from curadrift.llm import token_files as T, vocab

SCHEMA = "doc_id long, text string, ids string, start int, file string, crc int"
PATH = vocab.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = ["", None, " ", "Hello WORLD it's", "<|endoftext|>a<|startoftext|> b <|endoftext|", "é ́x Å ﬁ ½ Ⅷ İ ΟΔΟΣ ſ", "a\x1cb\x1d c\x85d\xa0e f​g᠎h",
         "日本語 テスト 🙂🙂 'll 're x'S", "12345 6,7 !?!'s ''t", "가 ̈́ יִ", "word " * 3000, "x" * 5000, "\n\n\t<|startoftext|>"]


def test_chunks_give_the_library_s_ids(library):
    coder = T.Encoder(PATH)
    every = ["a" + chr(c) + "b" + chr(c) + chr(c) + "c" for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F300, 0x1F700)]]
    texts = TEXTS + [" ".join(every[a:a + 50]) for a in range(0, len(every), 50)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u2").tolist() == library(text), text


def expected(docs, library):
    order = sorted(((d, library(t)) for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], dtype="<u2").tobytes())))
    at, out = 0, []
    for d, ids in order:
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize(("file_ids", "frame_ids"), [(T.FILE_IDS, T.FRAME_IDS), (1500, 64)])
def test_round_trip(spark, library, file_ids, frame_ids):
    docs = [(7 * i % 101, t) for i, t in enumerate(TEXTS * 4)] + [(None, "b c"), (None, "a"), (None, "a"), (3, "x y z"), (3, "x y z"), (-5, "minus")]
    frame = spark.createDataFrame([(d, t, "i", 1, "f", 2) for d, t in docs], SCHEMA).repartition(5)
    manifest = T.write_token_files(frame, PATH, file_ids=file_ids, frame_ids=frame_ids)
    got = sorted(T.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = expected(docs, library)
    assert [tuple(r) for r in got] == want
    files = manifest.orderBy("file_no").collect()
    assert sum(f.ids for f in files) == sum(len(w[4]) for w in want) and (len(files) > 3 or file_ids == T.FILE_IDS)
    asked = spark.createDataFrame([(3,), (-5,), (999,), (None,), (3,)], "doc_id long")
    some = sorted(T.read_documents(manifest, asked).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in some] == [w for w in want if w[0] in (3, -5)]


def written(docs, frame_ids):
    out = io.BytesIO()
    writer = T.Writer(out, 2, frame_ids)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, dtype="<u2").tobytes())
    writer.close()
    return out.getvalue()


def test_only_the_frames_asked_for_are_read():
    docs = [(i, list(range(i, i + 40))) for i in range(100)]
    data = written(docs, 50)
    reader = T.Reader(pa.BufferReader(data))
    assert reader.id_frames == 80 and reader.docs == 100
    listed = reader.directory()
    before = reader.frames_read
    one = listed.iloc[[61]]
    assert next(reader.documents(one["first"].tolist(), one["n"].tolist())).tolist() == docs[61][1]
    assert reader.frames_read - before <= 2
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as stream:
        assert stream.read(100 * 40 * 2) == b"".join(np.array(ids, dtype="<u2").tobytes() for _, ids in docs)


def test_a_damaged_frame_is_noticed():
    data = bytearray(written([(1, list(range(1000)))], 100))
    reader = T.Reader(pa.BufferReader(bytes(data)))
    data[int(reader.at[3]) + 20] ^= 1
    bad = T.Reader(pa.BufferReader(bytes(data)))
    assert next(bad.documents([0], [100])).tolist() == list(range(100))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(bad.documents([350], [10]))
    table = T.Reader(pa.BufferReader(bytes(data)))
    table.table[0][2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        table.frame(0)


def test_a_document_longer_than_a_file(spark, library):
    docs = [(1, "word " * 4000), (2, "b"), (3, "c " * 3000)]
    manifest = T.write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), PATH, file_ids=1000, frame_ids=128)
    assert [tuple(r) for r in sorted(T.read_token_files(manifest).collect(), key=lambda r: r.start)] == expected(docs, library)


def test_a_given_folder_and_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.read_token_files(T.write_token_files(empty, PATH)).collect() == []
    manifest = T.write_token_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, f"file://{tmp_path}/ids")
    assert [f.file for f in manifest.collect()] == os.listdir(tmp_path / "ids")
    assert T.read_token_files(manifest).first().ids == [320, 1]
