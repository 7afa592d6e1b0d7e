import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curadrift.llm import lexical as L

DOCS = "doc_id long, text string, score long, rank int, item long, bag string, m int"
ITEMS = "item_id long, text string, doc_id long, class_no int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + 90 * sum(bag.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in set(words(text)) if t in bag)
            if score > 0:
                scored.append((-score, i is not None, i, -score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i, _) in enumerate(scored[:best])]
    return sorted(out, key=str)


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["Straße", "naïve", "x1", "42", "日本", "été", "U.S", "don't"] + ["".join(rng.choice("abc") for _ in range(3)) for _ in range(25)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = [(i * 3 % 200, prose(rng.randint(0, 25))) for i in range(200)]
    docs += [(300 + i, docs[7][1] + "!" * i) for i in range(40)] + [(1000 - i, docs[9][1].upper()) for i in range(30)]
    docs += [(500, None), (501, ""), (502, "... !!"), (None, docs[7][1]), (None, docs[9][1]), docs[20], docs[20], (503, prose(4000))]
    items = [(i, prose(rng.randint(1, 8))) for i in range(20)] + [(30, None), (31, ""), (32, "zzz"), (None, "abc bca"), (5, "abc abc x1")]
    return docs, items


@pytest.mark.parametrize(("seed", "per_block"), [(1, L.ITEMS), (2, 7)])
def test_against_brute_force(spark, seed, per_block, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", per_block)
    monkeypatch.setattr(L, "CELLS", 900)
    docs, items = fixture(seed)
    got = L.ranked(
        spark.createDataFrame([(i, t, 1, 2, 3, "b", 4) for i, t in docs], DOCS).repartition(6),
        spark.createDataFrame([(i, t, 9, 8) for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_one_class_for_copies_in_another_order(spark):
    docs = spark.createDataFrame([(i, "red blue tail%d red" % (i % 3) if i % 2 else "BLUE, red; tail%d red" % (i % 3)) for i in range(60)] + [(99, "other words")],
                                 "doc_id long, text string")
    got = L.ranked(docs, spark.createDataFrame([(1, "red blue")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10)) and len({r.score for r in got}) == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = some.select(F.col("doc_id").alias("item_id"), "text")
    for d, i in ((docs, items), (docs, asked), (some, items)):
        assert L.ranked(d, i).collect() == []


def test_sql(duck):
    docs, items = fixture(3)
    docs = list({i: (i, t) for i, t in docs if i is not None}.values())
    items = list({i: (i, t) for i, t in items if i is not None}.values())
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    duck.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(duck.execute(L.SQL).fetchall(), key=str) == brute(docs, items)
