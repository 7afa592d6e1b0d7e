"""Ranked lexical search with bag deduplication.

1. Documents are restricted to the vocabulary of the items: a sorted vector of (term, tf). The score of a document depends
   on that vector and on ``m`` alone, a whole number that follows its length.
2. Documents with the same vector and ``m`` are a class: grouped by hash, and by the vector itself, which verifies it. A
   group of copies of any size is counted before it is shuffled. Document frequencies come from the classes.
3. Every class is scored once against every item; a task keeps the best classes of each item, with the least ``doc_id`` of a
   class to settle equal scores. No document outside the ten best classes can be among the ten best documents.
4. The best classes are expanded to their members by ascending ``doc_id``, at most ten of each.

Items are the stated queries. They are dealt into blocks of bounded size and each block meets all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curadrift.llm.common import parts_for, query, stored, table
from curadrift.session import small_side

BEST = 10
#: Items, and bytes of their texts, in a block.
ITEMS = 1000
ITEM_BYTES = 4 << 20
#: Scores a task holds at once.
CELLS = 1 << 20
#: ASCII letters in lower case and digits stay, other ASCII is a space; bytes above are parts of other characters.
TERM_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
LEAST_ID = -(1 << 63)


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other characters above ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def _bags(known: dict[bytes, int]):
    """Per document with a term: their number with repeats, and the vector of those in the vocabulary."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, bags = [], []
            for text in batch["text"]:
                found = terms(text)
                bag = sorted((known[t], tf) for t, tf in Counter(filter(known.__contains__, found)).items())
                sizes.append(len(found))
                bags.append(np.array(bag, dtype="<u4").tobytes())
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": np.array(sizes, dtype=np.int64), "bag": bags})
            yield out[out["n"] > 0]

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each term, from classes and their numbers of members."""
    for batch in batches:
        bags = [np.frombuffer(b, dtype="<u4")[::2] for b in batch["bag"]]
        if bags:
            members = np.repeat(batch["members"].to_numpy(), [len(b) for b in bags])
            term, at = np.unique(np.concatenate(bags), return_inverse=True)
            df = np.zeros(len(term), dtype=np.int64)
            np.add.at(df, at, members)
            yield pd.DataFrame({"term": term.astype(np.int64), "df": df})


def _scores(weights: np.ndarray, holders: list[np.ndarray], items: int, best: int):
    """The best classes of each item among a task's. ``holders``: items that hold each term."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[tuple]] = [[] for _ in range(items)]
        least = np.ones(items, dtype=np.int64)  # a score counts from here on
        step = max(1, CELLS // items)
        for batch in batches:
            for a in range(0, len(batch), step):
                cut = batch.iloc[a:a + step]
                vectors = [np.frombuffer(b, dtype="<u4") for b in cut["bag"]]
                pairs = np.concatenate(vectors).reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(len(cut)), [len(v) // 2 for v in vectors])
                term, tf, m = pairs[:, 0], pairs[:, 1], cut["m"].to_numpy()[row]
                share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                order = np.argsort(term, kind="stable")
                ends = np.flatnonzero(np.r_[term[order][1:] != term[order][:-1], True]) + 1 if len(order) else []
                scores = np.zeros((items, len(cut)), dtype=np.int64)
                begin = 0
                for end in ends:
                    of = order[begin:end]
                    scores[np.ix_(holders[term[of[0]]], row[of])] += share[of]
                    begin = end
                numbers, firsts = cut["class_no"].to_numpy(), cut["first_id"].to_numpy()
                for item in np.flatnonzero((scores >= least[:, None]).any(axis=1)).tolist():
                    line = scores[item]
                    at = np.flatnonzero(line >= least[item])
                    at = at[np.lexsort((numbers[at], firsts[at], -line[at]))[:best]]
                    kept[item] = sorted(kept[item] + list(zip((-line[at]).tolist(), firsts[at].tolist(), numbers[at].tolist(), strict=True)))[:best]
                    if len(kept[item]) == best:
                        least[item] = -kept[item][-1][0]
        rows = [(item, number, -minus, first) for item, found in enumerate(kept) for minus, first, number in found]
        if rows:
            yield pd.DataFrame(rows, columns=["item", "class_no", "score", "first_id"])

    return run


def _best(rows: DataFrame, group: str, order: list, best: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= best)


def _ranked_block(docs: DataFrame, texts: list[str | None], best: int, name: str) -> DataFrame:
    """``item`` (its place in ``texts``), ``rank``, ``doc_id``, ``score``."""
    wanted = [set(terms(t)) for t in texts]
    known = {t: k for k, t in enumerate(sorted(set().union(*wanted)))}
    bags = stored(docs.select("doc_id", "text").mapInPandas(_bags(known), "doc_id long, n long, bag binary"), f"{name}-bags")
    count, total = bags.agg(F.count("*"), F.sum("n")).first()
    held = bags.where(F.length("bag") > 0).withColumn(
        "m", F.expr(f"100L - 90L + (CAST(90L * n AS DECIMAL(38, 0)) * {count}L) div {total or 1}L")).withColumn("h", F.xxhash64("bag", "m"))
    classes = stored(
        held.groupBy("h", "m", "bag").agg(F.count("*").alias("members"), F.min(F.coalesce("doc_id", F.lit(LEAST_ID))).alias("first_id"))
        .withColumn("class_no", F.monotonically_increasing_id()), f"{name}-classes")
    df = classes.select("bag", "members").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(known), dtype=np.int64)
    for term, met in df.collect():  # at most the block's vocabulary
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * met + 1)))
    holders = [[] for _ in known]
    for item, words in enumerate(wanted):
        for word in words:
            holders[known[word]].append(item)
    scored = classes.select("bag", "m", "class_no", "first_id").mapInPandas(
        _scores(weights, [np.array(h) for h in holders], max(1, len(texts)), best), "item int, class_no long, score long, first_id long")
    winners = stored(_best(scored, "item", [F.desc("score"), "first_id", "class_no"], best).select("item", "class_no", "score"), f"{name}-winners")
    chosen = small_side(classes.join(winners.select("class_no").distinct(), "class_no").select("class_no", "h", "m", "bag"))
    members = _best(held.join(chosen, ["h", "m", "bag"]).select("class_no", "doc_id"), "class_no", ["doc_id"], best, "nth").drop("nth")
    return _best(winners.join(members, "class_no"), "item", [F.desc("score"), "doc_id"], best).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``best`` documents of ``docs`` (``doc_id``, ``text``) for each row of ``items``
    (``item_id``, ``text``), highest score first, ties by ascending ``doc_id`` (null first); a repeated row is a document of its own.

    Null and empty texts hold no term: such documents do not count and such items find nothing, as all do in an empty table.
    A repeated item row is answered once more. Other columns are ignored. Fewer rows where fewer documents score above 0.
    """
    queries = stored(items.select("item_id", "text").withColumn("row_no", F.monotonically_increasing_id()), "lexical-items")
    rows, size = queries.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, parts_for(rows, ITEMS), parts_for(size or 0, ITEM_BYTES))
    answers = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("row_no"), F.lit(blocks)) == block).orderBy("row_no").collect()
        if not part and answers is not None:
            continue
        found = _ranked_block(docs, [r["text"] for r in part], best, f"lexical-{block}")
        ids = docs.sparkSession.createDataFrame([(k, r["item_id"]) for k, r in enumerate(part)], "item int, item_id long")
        found = found.join(ids, "item").select("item_id", "rank", "doc_id", "score")
        answers = found if answers is None else answers.unionByName(found)
    return answers


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
found AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, whole GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM items JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked_search", SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
