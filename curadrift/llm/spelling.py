"""Spelling variants: words one edit apart, each led to its much commoner form.

1. Words are counted over all documents, a task's counts first.
2. Two words one edit apart share their first or their last half: the edit lies in one half only. So words meet in buckets
   of a shorter length and a half. A bucket beyond ``BLOCK`` words is cut into blocks, and every two blocks are a unit.
3. A unit's words are a bit-sliced index: for every (position, letter) the set of words that have it, a bit a word. A query
   word runs over it letter by letter. Word-parallel recurrences keep the set of words equal so far and the one-error sets
   of replacement, insertion and deletion, the last two with positions shifted by one. All words of a unit are queries at once.
4. Forms are followed to their roots by doubling; a form is at least ``RATIO`` times as common, which bounds the rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.llm.common import block_pairs, query, stored, table
from curadrift.session import small_side

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
SLIP = 31
BLOCK = 2048
#: Words, and letters, that share one index; long words make a smaller block.
TOGETHER = 512
LETTERS = 1 << 17
HELD_WORDS = 400_000
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with their counts, a frame whenever the words held are many."""
    counts: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts.keys()), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
            if not text:
                continue
            # bytes.lower changes A-Z only
            runs = Counter(RUNS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
            begun = zlib.crc32(f"{'' if pd.isna(doc_id) else int(doc_id)}:".encode())
            for run, n in runs.items():
                h = zlib.crc32(run.encode(), begun)
                if h % SLIP == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < LEAST_LETTERS:
                        continue
                counts[run] += n
            if len(counts) >= HELD_WORDS:
                yield frame()
                counts.clear()
    if counts:
        yield frame()


class BitIndex:
    """For each (position, letter) the bitset of the words that have it, and the bitsets of lengths."""

    def __init__(self, words: list[str]):
        self.width = -(-len(words) // 64)
        letters, where, owner, sizes = _letters(words)
        self.keys, rows = np.unique((where << 8) | letters, return_inverse=True)
        self.sets = self._packed(rows, owner, len(self.keys) + 1)  # the last row is empty
        self.lengths, rows = np.unique(sizes, return_inverse=True)
        self.of_length = self._packed(rows, np.arange(len(words)), len(self.lengths) + 1)
        # words longer than i, for every i that is some word's length or less: the lengths from there on together
        self.longer = np.bitwise_or.accumulate(self.of_length[:-1][::-1], axis=0)[::-1]

    def _packed(self, rows: np.ndarray, bits: np.ndarray, count: int) -> np.ndarray:
        out = np.zeros((count, self.width * 64), dtype=bool)
        out[rows, bits] = True
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def rows(self, positions: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Row of each (position, letter); the empty one where no word has it."""
        wanted = (positions << 8) | letters
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at, len(self.keys))

    def sized(self, length: int) -> np.ndarray:
        at = np.searchsorted(self.lengths, length)
        return self.of_length[at if at < len(self.lengths) and self.lengths[at] == length else -1]

    def beyond(self, position: int) -> np.ndarray:
        """Words that have a letter at ``position``."""
        at = np.searchsorted(self.lengths, position, side="right")
        return self.longer[at] if at < len(self.lengths) else self.of_length[-1]

    def one_edit(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that differ by exactly one inserted, deleted or replaced letter."""
        order = np.argsort([len(q) for q in queries], kind="stable")
        letters, where, _, sizes = _letters([queries[i] for i in order])
        starts = np.cumsum(sizes) - sizes
        here, ahead, behind = (self.rows(where + shift, letters) for shift in (0, 1, -1))
        found = np.zeros((len(queries), self.width), dtype=np.uint64)
        exact = np.full((len(queries), self.width), ~np.uint64(0))
        replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
        first = 0  # queries before it have ended
        for i in range(int(sizes[-1]) + 1 if len(sizes) else 0):
            done = int(np.searchsorted(sizes, i, side="right"))
            if done > first:
                ended = slice(first, done)
                found[ended] = ((replaced[ended] & self.sized(i)) | (shorter[ended] & self.sized(i - 1))
                                | ((longer[ended] | exact[ended]) & self.sized(i + 1)))
                first = done
            if first == len(queries):
                break
            live = slice(first, None)
            at = starts[live] + i
            same, after, before = self.sets[here[at]], self.sets[ahead[at]], self.sets[behind[at]]
            equal = exact[live]
            replaced[live] = (replaced[live] & same) | (equal & self.beyond(i) & ~same)
            longer[live] = (longer[live] | equal) & after
            shorter[live] = (shorter[live] & before) | equal
            exact[live] = equal & same
        q, w = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
        return order[q], w


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All letters one after the other: code, position in the word, the word's number; and the words' lengths."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    return letters, np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner, sizes


def _meets(a: str, b: str, lower: int, kind: int) -> bool:
    """Whether this bucket gives the pair: that of its shorter length, and of the first half if both halves are shared."""
    half = lower // 2
    return min(len(a), len(b)) == lower and (kind == 0 or a[:half] != b[:half])


def near_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs one edit apart, both ways, from rows sorted by unit (``lower``, ``bucket``, ``bi``, ``bj``). Units of one block are
    indexed several at a time; a unit of two blocks has one as the index and the other as the queries."""
    held: list[tuple] = []

    def found(words: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        if len(words) < 2:
            return out
        crossed = words[0][3] != words[0][4]
        index = [r for r in words if r[5] == r[3]] if crossed else words
        queries = [r for r in words if r[5] == r[4]] if crossed else words
        if not index or not queries:
            return out
        q, w = BitIndex([r[6] for r in index]).one_edit([r[6] for r in queries])
        for i, j in zip(q.tolist(), w.tolist(), strict=True):
            a, b = queries[i], index[j]
            if a[:5] == b[:5] and _meets(a[6], b[6], a[0], a[2]):
                out.append((a[6], b[6], b[7]))
                if crossed:
                    out.append((b[6], a[6], a[7]))
        return out

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["word", "near", "near_n"])

    letters = 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch[["lower", "bucket", "kind", "bi", "bj", "own", "word", "n"]].itertuples(index=False, name=None):
            if held and row[:5] != held[-1][:5] and (
                    len(held) >= TOGETHER or letters >= LETTERS or row[3] != row[4] or held[-1][3] != held[-1][4]):
                out += found(held)
                held, letters = [], 0
            held.append(row)
            letters += len(row[6])
        if out:
            yield frame(out)
    out = found(held)
    if out:
        yield frame(out)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``near``, ``near_n`` for every two of ``words`` (``word`` distinct, ``n``) that are one edit apart, both ways."""
    length = F.char_length("word")
    roles = words.withColumn("lower", F.explode(F.array_compact(F.array(length, F.when(length > LEAST_LETTERS, length - 1)))))
    half = F.floor(F.col("lower") / 2).cast("int")
    rows = roles.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "bucket", F.xxhash64("lower", "kind", F.when(F.col("kind") == 0, F.substring("word", F.lit(1), half)).otherwise(F.expr("right(word, lower div 2)"))))
    size = F.least(F.lit(block), F.greatest(F.lit(16), F.lit(LETTERS) / F.col("lower")))
    keys = ["lower", "kind", "bucket"]
    met = rows.groupBy(*keys).agg(F.count("*").alias("met")).where("met > 1")
    crowded = small_side(met.where(F.col("met") > size).withColumnRenamed("met", "many"))
    dealt = rows.join(crowded, keys, "left").withColumn("blocks", F.coalesce(F.col("many") / size, F.lit(1.0)))
    units = block_pairs(dealt, "bucket", "blocks", "word", 1).select("lower", "bucket", "kind", "bi", "bj", "own", "word", "n")
    order = ["lower", "bucket", "kind", "bi", "bj"]
    return units.repartition(*order).sortWithinPartitions(*order).mapInPandas(near_pairs, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word``, ``root`` for rows with a form, which is ``RATIO`` times as common: ``most`` is the highest count."""
    steps, reach = 1, LEAST_COUNT * RATIO
    while reach < most:
        steps, reach = steps + 1, reach * RATIO
    led = stored(forms.select("word", F.col("form").alias("root")), "spelling-led")
    for turn in range((steps - 1).bit_length()):
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        led = stored(led.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), f"spelling-led-{turn}")
    return led


def spelling_variants(docs: DataFrame) -> DataFrame:
    """A row per word of ``docs`` (``doc_id``, ``text``; other columns are ignored): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with the slips that
    the hash of id and run puts in; words of at least 7 letters met twice count. A null id prints as nothing. Null and
    empty texts have no word, a repeated row counts again, an empty table gives no row. Among the near words the commonest
    is the form, ties by code points, if it is ten times as common.
    """
    counted = docs.select("doc_id", "text").mapInPandas(word_counts, "word string, n long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    much = -F.col("best.minus") >= RATIO * F.col("n")
    told = stored(words.join(best, "word", "left").select(
        "word", F.when(much, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(much, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    led = roots(told.where("form IS NOT NULL"), words.agg(F.max("n")).first()[0] or 0)
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 (polynomial EDB88320) of a string by a table that SQL builds from the rule.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(
      regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda s, b: xor(s >> 8, t[xor(s % 256, b) + 1]))) AS h
  FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c
  FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min({'minus': -near_n, 'near': near}) AS best FROM pairs GROUP BY word),
told AS (
  SELECT w.word, CASE WHEN -best.minus >= 10 * n THEN best.near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.minus >= 10 * n THEN -best.minus END AS form_n
  FROM words w LEFT JOIN near USING (word)),
led AS (
  SELECT word, word AS at FROM told
  UNION ALL SELECT led.word, told.form FROM led JOIN told ON told.word = led.at WHERE told.form IS NOT NULL)
SELECT told.word, told.form, led.at AS root, told.n, told.n_near, told.form_n
FROM told JOIN led ON led.word = told.word JOIN told last ON last.word = led.at AND last.form IS NULL
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
