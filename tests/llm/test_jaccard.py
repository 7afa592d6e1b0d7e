import random

import numpy as np
import pytest

from curadrift.llm import jaccard as J

SCHEMA = "doc_id long, text string, members int, bucket string, set_id string"


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    kinds = {s: n for n, s in enumerate(dict.fromkeys(s if s else (t or "") for s, t in zip(sets, texts)))}
    keys = [kinds[s if s else (t or "")] for s, t in zip(sets, texts)]
    by_kind = {}
    for k, s in zip(keys, sets):
        by_kind[k] = s
    links = {k: {m for m in by_kind if m != k and by_kind[k] and by_kind[m]
                 and len(by_kind[k] & by_kind[m]) >= 0.8 * len(by_kind[k] | by_kind[m])} for k in by_kind}
    root = {}
    for k in by_kind:
        if k in root:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += links[x]
    least = {}
    for i, k in enumerate(keys):
        least[root[k]] = min(i, least.get(root[k], i))
    return [(least[root[k]], len(links[k]), keys.count(k)) for k in keys]


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: [word() for _ in range(n)]
    texts = [None, "", "  \n", "one", "One", "two words", "a b c d e", "a b c d e f", None]
    passage = prose(60)
    for _ in range(12):
        base = prose(rng.choice([12, 40, 90, 200]))
        for edits in (0, 0, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + prose(rng.choice([5, 14, 15, 16, 60]))))
    return texts


@pytest.mark.parametrize("block", [J.BLOCK, 3])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = fixture(block)
    rows = [(i, t, 1, "b", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.class_id, r.links, r.copies) for r in J.similarity_join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pruning_keeps_true_pairs_and_drops_far_ones():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 16, (2000, J.COMPARED)).astype(np.uint16)
    for share, kept in ((0.85, 1.0), (0.3, 0.01)):
        right = np.where(rng.random(left.shape) < share, left, left + 1).astype(np.uint16)
        at = np.arange(2000)
        assert abs(len(J.survivors(left, right, at, at)) / 2000 - kept) < 0.01
    assert (np.diff(J.keep_table()) > 0).all()


def test_one_of_each_keeps_columns_and_one_row_a_group(spark):
    texts = fixture(5)
    rows = [(i if i % 9 else None, t, i, "b", "s") for i, t in enumerate(texts)] + [(7, "a b c d e f", 7, "b", "s")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    want = brute([r[1] for r in rows])
    assert len(kept) == len({w[0] for w in want})
    assert len({(r.text or "") for r in kept}) == len(kept)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert J.similarity_join(empty).collect() == [] and J.one_of_each(empty).collect() == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "x y", 1, "", ""), (None, "x y", 1, "", ""), (4, "other", 1, "", "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.links, r.copies) for r in J.similarity_join(docs).collect())
    assert got == [(0, 0, 0, 2), (0, 0, 0, 2), (4, 4, 0, 1)]
