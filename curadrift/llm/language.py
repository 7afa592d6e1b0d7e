"""Language of texts by a linear-chain conditional random field over words.

A word's emission is linear in hashed features: character n-grams, affixes and the word itself where it is in the learned
lexicon. Transitions between the languages of neighbouring words are learned too, so a passage in another language is a
run of words with another label and not a vote for the document's. Forward-backward gives every word its posterior; a
document's score for a language is the mean posterior of its words.

The field is fitted on the driver from a bounded sample of labelled rows (``PER_LANGUAGE`` whole texts of each language, by
least hash). Document labels stand in for word labels at first; then transitions and emissions are fitted again to the
posteriors of the words, so that foreign passages in a labelled document stop counting for its language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from curadrift.llm.common import Numbered, query, table

PER_LANGUAGE = 200
BUCKETS = 1 << 17
LEXICON = 4000
GRAMS = (1, 2, 3, 4)
SCALE = 6.0
WORDS_AT_ONCE = 300_000
MIN_SCORE = 0.4
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams and affixes, the word each belongs to (ascending), and each word's lexicon bucket or -1."""
    joined = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = ends - np.repeat(sizes, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    found, whose = [], []
    value = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        follow = np.zeros(len(codes), dtype=np.uint64)
        follow[:len(codes) - n + 1] = codes[n - 1:]
        value = _mixed(value * np.uint64(31) + follow + np.uint64(n))
        inside = at + n <= ends
        if n in GRAMS:
            found.append((value[inside] % np.uint64(BUCKETS)).astype(np.int64))
            whose.append(owner[inside])
        if n == 4:  # affixes: the first and last three letters with the word's edge
            edge = inside & ((at == begins) | (at + n == ends))
            found.append((_mixed(value[edge] + (at[edge] == begins[edge])) % np.uint64(BUCKETS)).astype(np.int64))
            whose.append(owner[edge])
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return found[order], whose[order], np.array([lexicon.get(w, -1) for w in words], dtype=np.int64)


class Field:
    """Labels, lexicon, weights (bucket x label), lexicon weights, and log transitions of the fitted field."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS, len(labels)), dtype=np.float32)
        self.lexical = np.zeros((len(lexicon) + 1, len(labels)), dtype=np.float32)
        stay = 0.98 if len(labels) > 1 else 1.0
        self.transitions = np.full((len(labels), len(labels)), (1 - stay) / max(1, len(labels) - 1)) + np.eye(len(labels)) * (
            stay - (1 - stay) / max(1, len(labels) - 1))
        self.start = np.full(len(labels), 1 / len(labels))

    def emissions(self, found: np.ndarray, whose: np.ndarray, entry: np.ndarray) -> np.ndarray:
        count = len(entry)
        share = SCALE / np.bincount(whose, minlength=count)
        out = np.empty((count, len(self.labels)), dtype=np.float32)
        begins = np.searchsorted(whose, np.arange(count))
        for k in range(len(self.labels)):
            out[:, k] = np.add.reduceat(self.weights[found, k], begins) * share
        return out + self.lexical[entry]  # entry -1 is the last row, which stays 0

    def posteriors(self, chances: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """Posterior of every word of texts laid end to end (``sizes`` words each, none empty), from emission chances: all
        texts take a step at once, the longest first. With ``pairs`` also the expected transitions."""
        rank = np.argsort(-sizes, kind="stable")
        place = np.empty(len(sizes), dtype=np.int64)
        place[rank] = np.arange(len(sizes))
        step = np.arange(len(chances)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((np.repeat(place, sizes), step))
        p = chances[order].astype(np.float64)
        live = np.bincount(step)
        off = np.r_[0, np.cumsum(live)]
        ahead = np.empty_like(p)
        ahead[:off[1]] = p[:off[1]] * self.start
        ahead[:off[1]] /= ahead[:off[1]].sum(axis=1, keepdims=True)
        for t in range(1, len(live)):
            a, b, n = off[t], off[t + 1], live[t]
            now = ahead[off[t - 1]:off[t - 1] + n] @ self.transitions
            now *= p[a:b]
            now /= now.sum(axis=1, keepdims=True)
            ahead[a:b] = now
        behind = np.ones_like(p)
        seen = np.zeros_like(self.transitions)
        for t in range(len(live) - 1, 0, -1):
            a, b, n, before = off[t], off[t + 1], live[t], off[t - 1]
            right = p[a:b] * behind[a:b]
            if pairs:
                joint = ahead[before:before + n, :, None] * self.transitions[None] * right[:, None, :]
                seen += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = right @ self.transitions.T
            now /= now.sum(axis=1, keepdims=True)
            behind[before:before + n] = now
        both = ahead * behind
        both /= both.sum(axis=1, keepdims=True)
        out = np.empty_like(both)
        out[order] = both
        return (out, seen) if pairs else out

    def fit_emissions(self, found, whose, entry, target: np.ndarray, rounds: int = 40, rate: float = 0.5) -> None:
        """Weighted logistic regression by Adagrad; ``target``: expected count of each label for each distinct word."""
        weight = np.log1p(target.sum(axis=1))
        goal = target / np.maximum(target.sum(axis=1, keepdims=True), 1e-9)
        share = (SCALE / np.bincount(whose, minlength=len(entry)))[whose]
        past, past_lex = np.full_like(self.weights, 1e-4), np.full_like(self.lexical, 1e-4)
        for _ in range(rounds):
            error = (goal - chances_of(self.emissions(found, whose, entry), summed=True)) * weight[:, None]
            for k in range(len(self.labels)):
                step = np.bincount(found, weights=error[whose, k] * share, minlength=BUCKETS) - 0.01 * self.weights[:, k]
                past[:, k] += step ** 2
                self.weights[:, k] += rate * step / np.sqrt(past[:, k])
                step = np.bincount(entry[entry >= 0], weights=error[entry >= 0, k], minlength=len(self.lexical)) - 0.01 * self.lexical[:, k]
                past_lex[:, k] += step ** 2
                self.lexical[:, k] += rate * step / np.sqrt(past_lex[:, k])


def chances_of(emissions: np.ndarray, summed: bool = False) -> np.ndarray:
    """Emission scores as positive numbers, the largest of a word 1; ``summed``: adding up to 1."""
    out = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -30.0))
    return out / out.sum(axis=1, keepdims=True) if summed else out


def fitted(rows: list[tuple[str, str]], rounds: int = 2) -> Field | None:
    """The field for labelled texts, or None without any."""
    texts = [(words_of(text), lang) for text, lang in rows]
    texts = [(w, lang) for w, lang in texts if w]
    if not texts:
        return None
    labels = sorted({lang for _, lang in texts})
    number = {lang: n for n, lang in enumerate(labels)}
    counts = Counter(w for words, _ in texts for w in words)
    field = Field(labels, {w: n for n, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])})
    index = {w: n for n, w in enumerate(counts)}
    line = np.array([index[w] for words, _ in texts for w in words])
    sizes = np.array([len(words) for words, _ in texts])
    label = np.repeat([number[lang] for _, lang in texts], sizes)
    known = features(list(counts), field.lexicon)
    target = np.zeros((len(counts), len(labels)))
    np.add.at(target, (line, label), 1.0)
    # languages count alike, however many words the sample has of each
    even = len(label) / np.maximum(np.bincount(label, minlength=len(labels)), 1) / len(labels)
    field.fit_emissions(*known, target * even)
    for _ in range(rounds):
        chances = chances_of(field.emissions(*known))[line]
        after, seen = field.posteriors(chances, sizes, pairs=True)
        field.transitions = (seen + 1.0) / (seen + 1.0).sum(axis=1, keepdims=True)
        target[:] = 0
        for k in range(len(labels)):
            target[:, k] = np.bincount(line, weights=after[:, k], minlength=len(counts))
        field.fit_emissions(*known, target * even, rounds=15)
    return field


def predictions(texts: list[str | None], field: Field | None) -> list[tuple[str, float]]:
    """Language and score of each text; ``und`` and 0 where it has no letter."""
    return [(label, score) for label, score, _ in judged(texts, field)]


def judged(texts: list[str | None], field: Field | None) -> list[tuple[str, float, float]]:
    """Language and score of each text and how surely its words are in any language: the mean of each word's highest posterior."""
    out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    if field is None:
        return out
    held: list[int] = []
    lines: list[np.ndarray] = []
    index = Numbered()
    size = 0

    def settle() -> None:
        if not held:
            return
        sizes = np.array([len(x) for x in lines])
        chances = chances_of(field.emissions(*features(list(index), field.lexicon)))
        after = field.posteriors(chances[np.concatenate(lines)], sizes)
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        means = np.add.reduceat(after, begins, axis=0) / sizes[:, None]
        known = np.add.reduceat(after.max(axis=1), begins) / sizes
        best = means.argmax(axis=1)
        for n, k, row, sure in zip(held, best.tolist(), means, known.tolist(), strict=True):
            out[n] = (field.labels[k], float(min(1.0, max(0.0, row[k]))), float(min(1.0, max(0.0, sure))))
        held.clear(), lines.clear(), index.clear()

    for n, text in enumerate(texts):
        words = words_of(text)
        if not any(c.isalpha() for w in words for c in w):  # words may be numeric signs only
            continue
        if size + len(words) > WORDS_AT_ONCE:
            settle()
            size = 0
        held.append(n)
        lines.append(index.line(words))
        size += len(words)
    settle()
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field | None:
    """The field from rows of ``docs`` that may be learned from: a label, a text, an id that is not held out."""
    may = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    sample = may.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    return fitted([(r.text, r.lang) for r in sample.orderBy("lang", "nth").select("text", "lang").collect()])


def predictor(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """A column function from text to a struct of ``lang_pred``, ``score`` and ``known``, learned from ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(learned(docs, per_language))

    @F.pandas_udf(RESULT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame(judged(part.to_list(), held.value), columns=["lang_pred", "score", "known"])

    return predict


def identified(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``lang``): ``doc_id``, ``held_out``, ``lang_pred``, ``score``. Null ids are not held out and
    not learned from; without any labelled row every prediction is ``und``. Equal texts get equal predictions."""
    predict = predictor(docs)
    out = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_a_language(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose text has no letter or whose words' highest posteriors have a mean below ``least``; a text in
    several languages stays, all columns stay."""
    predict = predictor(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict("text").alias("p"))
    return packed.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.known") >= least)).select("row.*")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
