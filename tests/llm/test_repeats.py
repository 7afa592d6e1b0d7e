import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curadrift.llm import repeats as R

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, runs int"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, cover) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(d), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß\0 ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    texts = [None, "", "x", prose(60), "a" * (3 * length), "ab" * length, "a" * (length - 1), "a" * length]
    base = prose(80)
    for _ in range(25):
        cut = rng.randint(0, len(base))
        texts.append(base[:cut] + rng.choice("xyz") + base[cut:])
    for _ in range(30):
        texts.append(prose(rng.randint(0, 20)) + rng.choice(shared) + prose(rng.randint(0, 20)) + rng.choice(shared))
    return texts + texts[3:12] + [prose(5) for _ in range(10)]


@pytest.mark.parametrize("hot", [R.HOT_BYTES, 0])
@pytest.mark.parametrize("length", [24, 70])
def test_against_brute_force(spark, length, hot, monkeypatch):
    texts = fixture(length, length)
    monkeypatch.setattr(R, "SHARD_BYTES", 3000)
    monkeypatch.setattr(R, "GRAM", 8)
    monkeypatch.setattr(R, "HOT_BYTES", hot)
    rows = [(i, t, None, "s", 0, "k", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:5] for r in R.repeat_report(spark.createDataFrame(rows, SCHEMA).repartition(5), length).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want


def test_kernel_marks_what_brute_force_marks():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab\0") for _ in range(300))
    segments = [base[i:i + 120] + bytes(rng.choice(b"xyz") for _ in range(30)) for i in range(0, 150, 25)] + [b"a" * 90, b"short"]
    length = 40
    seen = Counter(s[i:i + length] for s in segments for i in range(len(s) - length + 1))
    for segment, runs in zip(segments, R.marked_runs(segments, length), strict=True):
        want = {i for i in range(len(segment) - length + 1) if seen[segment[i:i + length]] > 1}
        assert {i for s, e in runs for i in range(s, e + 1)} == want


def passage_brute(texts, passage):
    """Bytes of the words in repeated runs, per text."""
    words = [[(m.group(), *m.span()) for m in re.finditer(rb"[\xe3-\xe9][\x80-\xbf]{2}|(?:(?![\xe3-\xe9])[^\t\n\v\f\r ])(?:[^\t\n\v\f\r \xe3-\xe9])*", (t or "").encode())]
             for t in texts]
    seen = Counter(tuple(w[0] for w in ws[i:i + passage]) for ws in words for i in range(len(ws) - passage + 1))
    out = []
    for ws in words:
        marked = [False] * len(ws)
        for i in range(len(ws) - passage + 1):
            if seen[tuple(w[0] for w in ws[i:i + passage])] > 1:
                marked[i:i + passage] = [True] * passage
        runs, at = [], 0
        for flag, group in itertools.groupby(marked):
            size = len(list(group))
            if flag:
                runs.append((ws[at][1], ws[at + size - 1][2]))
            at += size
        out.append(runs)
    return out


def passages(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["a", "of", "the", "straße", "\u6f22\u5b57", "\u6f22", "x\u6f22y", "b."]) + rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n))
    shared = [prose(n) for n in (9, 10, 11, 14, 40)]
    texts = [None, "", "x", prose(60), "a " * 30, "b" * 500, "\u6f22" * 25, "a\tb\n" * 9]
    for _ in range(40):
        texts.append(prose(rng.randint(0, 15)) + rng.choice([" ", "\n", "  \t"]) + rng.choice(shared) + " " + prose(rng.randint(0, 9)) + "\n" + rng.choice(shared).replace(" ", "\n"))
    return texts + texts[3:9]


@pytest.mark.parametrize("hot", [R.HOT_BYTES, 0])
@pytest.mark.parametrize("passage", [10, 12])
def test_passages_against_brute_force(spark, passage, hot, monkeypatch):
    texts = passages(passage)
    monkeypatch.setattr(R, "SHARD_BYTES", 2000)
    monkeypatch.setattr(R, "WORD_GRAM", 3)
    monkeypatch.setattr(R, "HOT_BYTES", hot)
    docs = spark.createDataFrame([(i, t, None, "s", 0, "k", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    want = passage_brute(texts, passage)
    got = {r.doc_id: (r.n_passages, r.n_passage_bytes) for r in R.repeat_report(docs, 300, passage).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(runs), sum(e - s for s, e in runs)) for runs in want] and any(want)
    kept = {r.doc_id: r.text for r in R.without_repeats(docs, None, passage).collect()}
    for i, (text, runs) in enumerate(zip(texts, want)):
        data = (text or "").encode()
        for s, e in reversed(runs):
            data = data[:s] + data[e:]
        assert (kept[i] or "").encode() == data and (kept[i] is None) == (text is None)


def test_a_passage_of_fifty_words_stays_and_of_fifty_one_goes(spark):
    word = lambda k: f"w{k:x}"
    rows = [(0, " ".join(map(word, range(51))) + " tail one"), (1, "head two " + "\n".join(map(word, range(51)))), (2, " ".join(map(word, range(100, 150)))),
            (3, "x " + " ".join(map(word, range(100, 150))) + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.text for r in R.without_repeats(docs, None, R.PASSAGE).orderBy("doc_id").collect()] == [" tail one", "head two ", rows[2][1], rows[3][1]]


def test_without_repeats_keeps_columns_rows_and_characters(spark):
    passage = "ö" * 300
    rows = [(1, "début " + passage + " fin", "fr", "s", 310, "k", 1), (2, passage + "é", "de", "s", 301, "k", 2), (3, None, None, None, None, None, 3),
            (None, "clean", "en", "s", 5, "k", 4)]
    out = R.without_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = {r.runs: r for r in out.collect()}
    assert got[1].text == "début  fin" and got[2].text == "é" and got[2].n_chars == 1
    assert got[3].text is None and got[4].text == "clean" and len(got) == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repeat_report(empty).collect() == [] and R.without_repeats(empty).collect() == []


def test_exact_copies_lose_every_byte(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"))
    assert [r.n_removed for r in R.repeat_report(docs).collect()] == [500] * 50
