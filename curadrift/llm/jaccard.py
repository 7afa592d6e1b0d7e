"""Similarity join on word shingles with Bayesian candidate pruning.

Texts with equal shingle sets are one class; the join runs between classes, so copies cost nothing.

1. A class has ``BANDS * ROWS`` MinHash values. Classes that agree on a band share a bucket; at similarity 0.8 a pair
   misses all buckets with probability 3e-6. Only buckets with two members or more go on.
2. In a bucket, MinHash values are compared ``STEP`` at a time. After each step the posterior probability that the
   similarity reaches the threshold, given the matches so far and a uniform prior, is read from a table; pairs below
   ``TOLERANCE`` are dropped. Survivors only tie the bucket's members into groups, so a bucket gives at most a link per
   member and no list of pairs.
3. The exact similarity of all pairs inside a group is counted from a shingle matrix, after the same pruning with the
   values that the shingles give. Links are counted per class, and again only ties leave the task.

Buckets and groups of any size are dealt into blocks of bounded size, a unit of work for each pair of blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curadrift.llm.common import block_pairs, by_units, components, query, release, stored, table

WORDS = 5
THRESHOLD = 0.8
ROWS = 6
BANDS = 42
STEP = 16
COMPARED = 64
TOLERANCE = 1e-9
BLOCK = 512
PAIRS_AT_ONCE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` lower-case words; a shorter text is one run, a text without
    words none. Words are hashed once each, runs by combining them in order."""
    found = (text or "").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(_runs(_word_hashes(found), words))


def _word_hashes(found: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def _runs(hashes: np.ndarray, words: int) -> np.ndarray:
    width = min(words, len(hashes))
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = _mixed(total + hashes[i:len(hashes) - width + 1 + i])
    return total


@functools.lru_cache(maxsize=2)
def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    odd = _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return odd | np.uint64(1), _mixed(odd)


def minhashes(sets: list[np.ndarray], count: int = ROWS * BANDS) -> np.ndarray:
    """32-bit MinHash values of non-empty sets, a row each."""
    sizes = np.array([len(s) for s in sets])
    begins = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    values = np.concatenate(sets)
    factor, shift = _seeds(count)
    out = np.empty((len(sets), count), dtype=np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(values * factor[k] + shift[k], begins) >> np.uint64(32)
    return out


@functools.lru_cache(maxsize=4)
def keep_table(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, compared: int = COMPARED) -> np.ndarray:
    """Least number of matches after each step that keeps a pair: with m of n matches and a uniform prior the similarity
    is Beta(m + 1, n - m + 1), whose tail above the threshold is a binomial sum."""
    least = []
    for n in range(step, compared + 1, step):
        tail = [sum(math.comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1)) for m in range(n + 1)]
        least.append(next(m for m in range(n + 1) if tail[m] >= tolerance))
    return np.array(least)


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (i of left, j of right) keep a posterior probability above the tolerance."""
    live = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int64)
    for t, least in enumerate(keep_table(threshold)):
        part = slice(t * STEP, (t + 1) * STEP)
        matches[live] += (left[i[live], part] == right[j[live], part]).sum(axis=1)
        live = live[matches[live] >= least]
    return live


def pairs_of(own: np.ndarray, bi: int, bj: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a unit: those between its two blocks, or inside its only one, in pieces of bounded size."""
    if bi != bj:
        a, b = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        rows = max(1, PAIRS_AT_ONCE // max(1, len(b)))
        for s in range(0, len(a), rows):
            yield np.repeat(a[s:s + rows], len(b)), np.tile(b, len(a[s:s + rows]))
        return
    n = len(own)
    rows = max(1, PAIRS_AT_ONCE // max(1, n))
    for s in range(0, n, rows):
        i, j = np.meshgrid(np.arange(s, min(s + rows, n)), np.arange(n), indexing="ij")
        above = (j > i).ravel()
        yield i.ravel()[above], j.ravel()[above]


class Ties:
    """Union of rows by least index, fed with whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        tied = np.flatnonzero(self.root != np.arange(len(self.root)))
        return tied, self.root[tied]


def _signatures(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                cut = batch.iloc[a:a + 500]
                sets = [shingles(t, words) for t in cut["text"]]
                some = [n for n, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                values = minhashes([sets[n] for n in some])
                keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = _mixed(keys + values[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r + 1))
                keys = _mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                short = values[:, :COMPARED].astype("<u2")
                yield pd.DataFrame({
                    "text_id": cut["text_id"].to_numpy()[some], "set_id": [_set_id(sets[n]) for n in some],
                    "bands": list(keys), "sig": [s.tobytes() for s in short],
                })

    return run


def _set_id(values: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(values.tobytes())


def _tie_bucket(threshold: float):
    def run(unit: pd.DataFrame) -> pd.DataFrame | None:
        if len(unit) < 2:
            return None
        sig = np.frombuffer(b"".join(unit["sig"]), dtype="<u2").reshape(len(unit), COMPARED)
        ties = Ties(len(unit))
        for i, j in pairs_of(unit["own"].to_numpy(), unit["bi"].iat[0], unit["bj"].iat[0]):
            fresh = ties.root[i] != ties.root[j]
            i, j = i[fresh], j[fresh]
            live = survivors(sig, sig, i, j, threshold)
            ties.join(i[live], j[live])
        a, b = ties.links()
        ids = unit["set_id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]}) if len(a) else None

    return run


def _exact_unit(threshold: float, words: int):
    def run(unit: pd.DataFrame) -> pd.DataFrame | None:
        if len(unit) < 2:
            return None
        sets = [shingles(t, words) for t in unit["text"]]
        sig = minhashes(sets, COMPARED).astype(np.uint16)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values, columns = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(columns, minlength=len(values)) > 1  # a shingle of one set meets no other
        begins = np.r_[0, np.cumsum(sizes)]
        numbers = np.cumsum(often) - 1
        held = [numbers[c[often[c]]] for c in (columns[begins[n]:begins[n + 1]] for n in range(len(sets)))]
        ties, links = Ties(len(unit)), np.zeros(len(unit), dtype=np.int64)
        ids = unit["set_id"].to_numpy()
        for i, j in pairs_of(unit["own"].to_numpy(), unit["bi"].iat[0], unit["bj"].iat[0]):
            live = survivors(sig, sig, i, j, threshold)
            i, j = i[live], j[live]
            if not len(i):
                continue
            both = _intersections(held, i, j, int(often.sum()))
            enough = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
            i, j = i[enough], j[enough]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            ties.join(i, j)
        a, b = ties.links()
        linked = np.flatnonzero(links)
        return pd.DataFrame({
            "set_id": np.r_[ids[linked], ids[a]], "links": np.r_[links[linked], np.zeros(len(a), dtype=np.int64)],
            "tie": np.r_[np.full(len(linked), None, dtype=object), ids[b]],
        }) if len(linked) else None

    return run


def _intersections(held: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Common shingles of the pairs: one product of 0/1 matrices where pairs are many, else pair by pair."""
    if len(i) <= 8:
        return np.array([len(np.intersect1d(held[a], held[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    rows, left = np.unique(i, return_inverse=True)
    cols, right = np.unique(j, return_inverse=True)
    total = np.zeros((len(rows), len(cols)), dtype=np.float32)
    step = 4096

    def matrix(which: np.ndarray, begin: int) -> np.ndarray:
        out = np.zeros((len(which), min(step, width - begin)), dtype=np.float32)
        for n, w in enumerate(which):
            c = held[w]
            out[n, c[(c >= begin) & (c < begin + step)] - begin] = 1
        return out

    for begin in range(0, width, step):
        total += matrix(rows, begin) @ matrix(cols, begin).T
    return np.rint(total[left, right]).astype(np.int64)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per distinct text: ``text_id`` (md5 of the text), ``set_id`` (its class of equal shingle sets), ``group_id`` (the least class
    it is linked with, directly or in a chain) and ``links`` (other classes whose Jaccard similarity reaches the threshold).

    ``docs`` needs ``text``. A text without words has no shingles: null class, a group of its own, no links.
    """
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = stored(texts.groupBy("text_id").agg(F.first("text").alias("text")), "jaccard-texts")
    signed = stored(seen.mapInPandas(_signatures(words), "text_id string, set_id string, bands array<long>, sig binary"), "jaccard-signatures")
    classes = signed.groupBy("set_id").agg(F.min_by(F.struct("bands", "sig"), "text_id").alias("c"), F.min("text_id").alias("text_id"))
    classes = stored(classes.select("set_id", "text_id", "c.bands", "c.sig"), "jaccard-classes")
    banded = classes.select("set_id", F.explode("bands").alias("bucket"))
    # buckets that hold the same members as another one are judged once
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("set_id")).alias("who")).where("members > 1")
    once = buckets.groupBy("who", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    chosen = banded.join(once, "bucket").join(classes.select("set_id", "sig"), "set_id")
    units = block_pairs(chosen, "bucket", "members", "set_id", BLOCK).select("bucket", "bi", "bj", "own", "set_id", "sig")
    tied = by_units(units, ["bucket", "bi", "bj"], _tie_bucket(threshold), "a string, b string", ["set_id"])
    loose = components(tied, "jaccard-loose")
    counted = loose.join(loose.groupBy("root").agg(F.count("*").alias("members")), "root").withColumnRenamed("node", "set_id")
    texted = counted.join(classes.select("set_id", "text_id"), "set_id").join(seen, "text_id")
    units = block_pairs(texted, "root", "members", "set_id", BLOCK).select("root", "bi", "bj", "own", "set_id", "text")
    judged = stored(by_units(units, ["root", "bi", "bj"], _exact_unit(threshold, words), "set_id string, links long, tie string", ["set_id"]), "jaccard-links")
    groups = components(judged.where("tie is not null").select(F.col("set_id").alias("a"), F.col("tie").alias("b")), "jaccard-groups")
    links = judged.groupBy("set_id").agg(F.sum("links").alias("links"))
    known = signed.select("text_id", "set_id").join(links, "set_id", "left").join(
        groups.select(F.col("node").alias("set_id"), F.col("root").alias("group_id")), "set_id", "left")
    found = stored(seen.select("text_id").join(known, "text_id", "left").select(
        "text_id", "set_id", F.coalesce("group_id", "set_id", "text_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-found")
    release(seen, signed, classes, loose, judged, groups)
    return found


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``class_id`` (least ``doc_id`` of its group of linked texts), ``set_id``,
    ``links`` (different shingle sets it is linked with) and ``copies`` (rows with its shingle set, itself included).

    Null and empty texts form one class of copies; repeated rows are copies; a group of null ids has a null class id.
    """
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"))
    found = near_copies(docs, threshold, words)
    keyed = rows.groupBy("text_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).join(found, "text_id")
    set_key = F.coalesce("set_id", "text_id")
    of_set = keyed.groupBy(set_key.alias("set_key")).agg(F.sum("rows").alias("copies"))
    of_group = keyed.groupBy("group_id").agg(F.min("least").alias("class_id"))
    full = keyed.withColumn("set_key", set_key).join(of_set, "set_key").join(of_group, "group_id")
    return rows.join(full.select("text_id", "class_id", "set_id", "links", "copies"), "text_id").select(
        "doc_id", "class_id", "set_id", "links", "copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least ``doc_id``, nulls last, then the least row
    hash. All columns stay. Rows without words stay apart from all others but their exact copies."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.withColumn("text_id", F.md5(F.coalesce("row.text", F.lit("")))).withColumn("mark", F.xxhash64("row"))
    groups = near_copies(docs.select("text"), threshold, words).select("text_id", "group_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "mark", "text_id")
    # the choice is made among ids; whole rows are only filtered
    least = held.select("text_id", order.alias("at")).join(groups, "text_id").groupBy("group_id").agg(F.min("at").alias("at"))
    chosen = least.select(F.col("at.mark").alias("mark"), F.col("at.text_id").alias("text_id"))
    kept = held.join(chosen, ["text_id", "mark"])
    # rows equal in every column are one document
    first = Window.partitionBy("text_id", "mark").orderBy(F.lit(0))
    return kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))
