import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from curadrift.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, root string, bucket int"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def fixture(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéßöÿ") for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "Öffnung", "z" * 300]
    edited = []
    for w in stems:
        for _ in range(6):
            i = rng.randint(0, len(w) - 1)
            edited.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1:]]))
    docs = [(i, " ".join(rng.choices(stems, k=30)) + rng.choice([", ", "\n", "_"]) + " ".join(rng.choices(edited, k=6)).upper()) for i in range(60)]
    docs += [(104, "Kettenende " * 500 + "kettenendf " * 50 + "kettenendff " * 5), (100, " ".join(stems[:2] * 150)), (101, " ".join([stems[0]] * 1500)), (None, "Straßen " * 3), (None, None), (None, "Straßen " * 3), (102, ""), (103, "a b c")]
    return docs + docs[:2]


@pytest.mark.parametrize(("seed", "block"), [(1, S.BLOCK), (2, 6)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(S.near_words, "__defaults__", (block,))
    docs = fixture(seed)
    frame = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], SCHEMA).repartition(5)
    got = [tuple(r) for r in S.spelling_variants(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_index_finds_what_brute_force_finds():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    q, w = S.BitIndex(words[:200]).one_edit(words[100:])
    want = {(i, j) for i, a in enumerate(words[100:]) for j, b in enumerate(words[:200]) if one_edit(a, b)}
    assert set(zip(q.tolist(), w.tolist())) == want and len(q) == len(want)


def test_chains_lead_to_one_root(spark):
    chain = [("kettenende", 20000), ("kettenendf", 2000), ("kettenendff", 200), ("kettenndff", 20), ("ettenndff", 2)]
    forms = spark.createDataFrame([(a, b) for (b, _), (a, _) in itertools.pairwise(chain)], "word string, form string")
    assert {r.root for r in S.roots(forms, 20000).collect()} == {"kettenende"}


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark, duck):
    docs = fixture(3)
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert set(duck.execute(S.SQL).fetchall()) == brute(docs)
