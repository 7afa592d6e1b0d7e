import hashlib
import random

import numpy as np

from curadrift.llm import fingerprints as P

SCHEMA = "doc_id long, text string, n_chars string, part int, place string"


def walked(text):
    """One text at a time, as the definition says."""
    out = np.full((P.WALKS, P.SLOTS), P.UNSET, dtype=np.uint8)
    symbols = [int(P._mixed(np.array([ord(c)], dtype=np.uint64))[0] % np.uint64(P.UNSET)) for c in text]
    best = {}
    for walk in range(P.WALKS):
        at = step = 0
        while at < len(text):
            slot = int(P._mixed(np.array([step * 2 * P.WALKS + 2 * walk + 1], dtype=np.uint64))[0] % np.uint64(P.SLOTS))
            rank = int(P._mixed(np.array([step * 2 * P.WALKS + 2 * walk + 2 + (1 << 60)], dtype=np.uint64))[0])
            if rank <= best.get((walk, slot), 1 << 64):
                best[walk, slot] = rank
                out[walk, slot] = symbols[at]
            at += int(P.moves()[step % P.PERIOD, walk * 256 + symbols[at]])
            step += 1
    return out.ravel()


def test_against_one_walk_at_a_time():
    texts = ["", "a", "aa", "hello world " * 20, "é日本𝄞" * 7, "x" * 900]
    for text, got in zip(texts, P.fingerprints(texts), strict=True):
        assert (got == walked(text)).all()


def test_small_edits_stay_near_and_other_texts_far():
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    base = [prose(300) for _ in range(30)]
    near = [t[:(c := rng.randrange(len(t)))] + "q" + t[c:] for t in base]
    a, b = P.fingerprints(base), P.fingerprints(near)
    assert P.likeness(a, b).mean() > 0.75
    assert P.likeness(a, np.roll(a, 1, axis=0)).mean() < 0.25


def check(rows, texts, order):
    prints = {t: p for t, p in zip(texts, P.fingerprints(texts))}
    assert len(rows) == len(order)
    for r, i in zip(rows, range(len(order)), strict=True):
        text, following = order[i][1], order[(i + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.doc_id == order[i][0] and r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        other = P.fingerprints([changed])[0]
        assert r.fingerprint == prints[text].tobytes().hex() and r.edited_fingerprint == other.tobytes().hex()
        assert r.near_edited == P.likeness(prints[text], other) and r.near_next == P.likeness(prints[text], prints[following])


def test_order_across_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "CHARS_AT_ONCE", 60)
    monkeypatch.setattr(P, "ROWS_PER_PART", 5)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.choice([0, 1, 2, 9, 30]))) for _ in range(60)]
    rows = [(i * 7 - 100, t, "", 1, "") for i, t in enumerate(texts)]
    got = P.fingerprint_report(spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(3)).collect()
    check(sorted(got, key=lambda r: r.doc_id), texts, [(r[0], r[1]) for r in rows])


def test_null_texts_null_ids_one_row_and_none(spark):
    rows = [(None, "first", "", 1, ""), (3, None, "", 1, ""), (9, "last one", "", 1, "")]
    got = P.fingerprint_report(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    check(got, ["first", "", "last one"], [(None, "first"), (3, ""), (9, "last one")])
    one = P.fingerprint_report(spark.createDataFrame([(5, "alone", "", 1, "")], SCHEMA)).collect()
    check(one, ["alone"], [(5, "alone")])
    assert one[0].near_next == 1.0
    assert P.fingerprint_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_groups(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts, want = [], []
    for g in range(12):
        base = prose(250)
        texts += [base, base, base[:-40] + "zz" + base[-40:], base + " end"]
        want += [g] * 4
    docs = spark.createDataFrame([(i, t, "", 1, "") for i, t in enumerate(texts)], SCHEMA)
    prints = P.fingerprinted(docs)
    groups = {bytes(r.fingerprint): r.group_id for r in P.near_groups(prints).collect()}
    of = {r.doc_id: groups[bytes(r.fingerprint)] for r in prints.collect()}
    found = [of[i] for i in range(len(texts))]
    assert len({*zip(found, want)}) == len(set(found)) == 12
