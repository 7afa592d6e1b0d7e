"""Quality and toxicity from weak labels.

Heuristic labellers vote on every document, for each of two questions: is it junk, is it toxic? Their votes overlap and
contradict. Votes are counted by pattern over all documents; expectation-maximisation (Dawid and Skene, 1979) on those
counts estimates how often each labeller votes what for either answer, with no labeller trusted beforehand beyond its
starting point. The posterior of a document's pattern is its label, and such labels train a linear scorer over hashed
words, word stems and shape, which then scores every whole text.

People who labelled some documents are one more labeller, silent on the rest. Two labellers of toxicity are lists of
words and of stems learned from a bounded sample of what people labelled (``LABELLED`` rows expected).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curadrift.llm.common import Numbered, query, stored, table

BUCKETS = 1 << 18
LABELLED = 6000
SAMPLE = 2000
STEM = 5
SEEN = 4
SMOOTH = 2.0
LEAST_ODDS = 1.5
PENALTY = 10.0
RARE = 3.0
JUNK_LIMIT = 0.5
TOXIC_LIMIT = 0.4
CHARS_AT_ONCE = 4 << 20
CLEAN, BAD, SILENT = 0, 1, 2
JUNK = ("repetition", "symbols", "table", "capitals", "variety", "plain", "people")
TOXIC = ("insults", "words", "stems", "people")
WORD = re.compile(r"\w+")

# Insults.
INSULTS = ["idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "trash", "scum", "clown", "imbecile", "dumb", "jerk", "bastard",
           "idiota", "estúpido", "imbécil", "basura", "idiote", "stupide", "crétin", "ordure", "dummkopf", "trottel", "abschaum", "arschloch"]


class Reading:
    """Words of a batch of texts as numbers, and what is known of each different word."""

    def __init__(self, texts: list[str]):
        index = Numbered()
        lines = [index.line(t.split()) for t in texts]
        self.count = len(texts)
        self.sizes = np.array([len(x) for x in lines], dtype=np.int64)
        self.line = np.concatenate(lines) if lines else np.zeros(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.words = list(index)
        self.plain = [w.lower().strip("!?.,;:\"'()[]#$%&*|") for w in self.words]

    def share(self, flags) -> np.ndarray:
        """Share of each text's words that have the flag; 0 for a text without words."""
        held = np.fromiter(flags, dtype=np.float64, count=len(self.words))
        return np.bincount(self.owner, weights=held[self.line] if len(held) else None, minlength=self.count) / np.maximum(self.sizes, 1)

    def shape(self) -> dict[str, np.ndarray]:
        ends = self.line[1:] == self.line[:-1]
        same = np.r_[False, ends & (self.owner[1:] == self.owner[:-1])] if len(self.line) else np.zeros(0, dtype=bool)
        different = np.unique(self.owner * max(1, len(self.words)) + self.line) // max(1, len(self.words))
        return {
            "repeated": np.bincount(self.owner, weights=same, minlength=self.count) / np.maximum(self.sizes, 1),
            "symbols": self.share(len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() for w in self.words),
            "bars": self.share(w == "|" for w in self.words),
            "capitals": self.share(sum(c.isupper() for c in w) > 1 and not any(c.islower() for c in w) for w in self.words),
            "variety": np.bincount(different, minlength=self.count) / np.maximum(self.sizes, 1),
            "words": self.sizes.astype(np.float64),
        }

    def hits(self, flags) -> np.ndarray:
        """How many words of each text have the flag."""
        return np.rint(self.share(flags) * self.sizes)


def votes(reading: Reading, words: set[str], stems: set[str]) -> dict[str, np.ndarray]:
    """Votes of the labellers that read the text."""
    shape = reading.shape()
    none = reading.sizes == 0

    def vote(bad, clean):
        return np.where(none, SILENT, np.where(bad, BAD, np.where(clean, CLEAN, SILENT)))

    insults, known, stemmed = (reading.hits(w in INSULT_SET for w in reading.plain), reading.hits(w in words for w in reading.plain),
                               reading.hits(w[:STEM] in stems for w in reading.plain))
    # each kind of junk is seen by a labeller that is silent on all else; one labeller vouches for texts without a sign of any
    plain = (shape["repeated"] < 0.05) & (shape["symbols"] < 0.05) & (shape["bars"] < 0.03) & (shape["capitals"] < 0.05) & (shape["variety"] > 0.2)
    return {
        "repetition": vote(shape["repeated"] > 0.15, False), "symbols": vote(shape["symbols"] > 0.2, False),
        "table": vote(shape["bars"] > 0.15, False), "capitals": vote(shape["capitals"] > 0.25, False),
        "variety": vote((shape["variety"] < 0.15) & (reading.sizes < 2000), False), "plain": vote(False, plain),
        "insults": vote(insults > 1, insults == 0), "words": vote(known > 1, known == 0), "stems": vote(stemmed > 1, stemmed == 0),
    }


INSULT_SET = set(INSULTS)


def learned_lists(rows: list[tuple[str, int]]) -> tuple[set[str], set[str]]:
    """Words, and stems, that stand in several toxic texts and hardly in others."""
    def telling(form):
        toxic, clean, base = Counter(), Counter(), Counter()
        for text, label in rows:
            base[label] += 1
            (toxic if label else clean).update({form(w) for w in WORD.findall(text.lower())})
        odds = (base[0] + 1) / (base[1] + 1)
        return {w for w, n in toxic.items() if n >= 4 and n * odds >= 20 * (clean[w] + 0.25)}

    return telling(lambda w: w), telling(lambda w: w[:STEM])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of the bad answer and ``rates[labeller, answer, vote]``, from vote patterns (a row each) and how often they occur."""
    labellers = patterns.shape[1]
    rates = np.empty((labellers, 2, 3))
    rates[:, 0] = [0.60, 0.01, 0.39]  # a labeller seldom calls a good document bad
    rates[:, 1] = [0.20, 0.20, 0.60]
    prior = 0.1
    for _ in range(rounds):
        after = posterior(patterns, prior, rates)
        mass = np.stack([counts * (1 - after), counts * after])
        prior = float(np.clip(mass[1].sum() / max(counts.sum(), 1e-9), 1e-4, 0.5))
        fresh = np.empty_like(rates)
        for n in range(labellers):
            for v in (CLEAN, BAD, SILENT):
                fresh[n, :, v] = mass[:, patterns[:, n] == v].sum(axis=1) + 0.5
        fresh /= fresh.sum(axis=2, keepdims=True)
        if np.abs(fresh - rates).max() < 1e-7:
            break
        rates = fresh
    return prior, rates


def posterior(patterns: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """Probability of the bad answer for each pattern; silence says nothing."""
    at = np.arange(patterns.shape[1])
    spoken = patterns != SILENT
    good = np.log(1 - prior) + (np.log(rates[at, 0, patterns]) * spoken).sum(axis=1)
    bad = np.log(prior) + (np.log(rates[at, 1, patterns]) * spoken).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))


def _coded(found: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Votes as one number, three values a labeller; people are silent here."""
    total = 0
    for n, name in enumerate(names):
        total = total + found.get(name, SILENT) * 3 ** n
    return total


def decoded(codes: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([codes // 3 ** n % 3 for n in range(len(names))], axis=1)


def _features(reading: Reading) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features that a text has, as (text, bucket), each once: words, stems, and the shape in steps."""
    if not reading.words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys = np.array([[xxhash.xxh32_intdigest("w" + w), xxhash.xxh32_intdigest("s" + w[:STEM])] for w in reading.plain], dtype=np.int64) % BUCKETS
    found = [np.stack([reading.owner, keys[reading.line, k]]) for k in (0, 1)]
    for n, (name, values) in enumerate(sorted(reading.shape().items())):
        steps = np.floor(np.log2(values + 1)) if name == "words" else np.floor(values * 20)
        found.append(np.stack([np.arange(reading.count), (n * 1009 + steps.astype(np.int64) * 31 + 7) * 2654435761 % BUCKETS]))
    both = np.concatenate(found, axis=1)
    joint = np.unique(both[0] * BUCKETS + both[1])
    return joint // BUCKETS, joint % BUCKETS


def features_of(texts: list[str], chars_at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """``_features`` of many texts, read a bounded piece at a time."""
    rows, buckets, begin = [], [], 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= chars_at_once):
            size += len(texts[stop])
            stop += 1
        text, bucket = _features(Reading(texts[begin:stop]))
        rows.append((text + begin).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
        begin = stop
    none = np.zeros(0, dtype=np.int32)
    return np.concatenate([none, *rows]), np.concatenate([none, *buckets])


class Scorer:
    """Logistic scorers over hashed features, one for each question."""

    def __init__(self):
        self.weights = np.zeros((BUCKETS, 2), dtype=np.float32)
        self.bias = np.zeros(2)

    def margins(self, text: np.ndarray, bucket: np.ndarray, count: int) -> np.ndarray:
        return np.stack([np.bincount(text, weights=self.weights[bucket, k], minlength=count) for k in (0, 1)], axis=1) + self.bias

    def fit(self, text: np.ndarray, bucket: np.ndarray, goal: np.ndarray, rounds: int = 150, rate: float = 0.1) -> None:
        """Adagrad on whole passes over features that ``SEEN`` texts have. A feature counts as much as its odds between the
        answers tell (Wang and Manning, 2012), so the many words that tell nothing cannot be fitted to chance."""
        often = np.bincount(bucket, minlength=BUCKETS)[bucket] >= SEEN
        text, bucket = text[often], bucket[often]
        for k in (0, 1):
            mass = goal[:, k]
            base = np.clip(mass.mean(), 1e-3, 0.999)
            bad = np.bincount(bucket, weights=mass[text], minlength=BUCKETS)
            good = np.bincount(bucket, weights=1 - mass[text], minlength=BUCKETS)
            odds = np.log((bad + SMOOTH * base) / (good + SMOOTH * (1 - base))) - np.log(base / (1 - base))
            scale = np.where(np.abs(odds) > LEAST_ODDS, odds, 0.0)
            told = scale[bucket] != 0
            rows, columns = text[told], bucket[told]
            weight, past, bias, past_bias = np.zeros(BUCKETS), np.full(BUCKETS, 1.0), np.log(base / (1 - base)), 1.0
            for _ in range(rounds):
                margin = np.bincount(rows, weights=(scale * weight)[columns], minlength=len(goal)) + bias
                error = (mass - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) * np.where(mass > 0.5, RARE, 1.0)
                step = np.bincount(columns, weights=error[rows], minlength=BUCKETS) * scale - PENALTY * weight
                past += step ** 2
                weight += rate * step / np.sqrt(past)
                past_bias += error.sum() ** 2
                bias += rate * error.sum() / np.sqrt(past_bias)
            self.weights[:, k], self.bias[k] = scale * weight, bias

    def scores(self, reading: Reading) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*_features(reading), reading.count), -30, 30)))


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    begin = size = 0
    for n, length in enumerate(batch["text"].str.len()):
        if n > begin and size + length > CHARS_AT_ONCE:
            yield batch.iloc[begin:n]
            begin, size = n, 0
        size += length
    if len(batch):
        yield batch.iloc[begin:]


def _bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(29)), F.lit(1_000_000))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _people(labels: DataFrame) -> DataFrame:
    """One row an id: the label that most gave it, bad on a tie; nulls are no labels."""
    def most(c):
        return F.when(F.count(c) > 0, (F.avg(c.cast("double")) >= 0.5).cast("int"))

    return labels.where("doc_id is not null").groupBy("doc_id").agg(most(1 - F.col("quality")).alias("junk"), most(F.col("toxic")).alias("toxic"))


def judged(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``junk`` and ``toxic`` (0 to 1), ``keep`` (both below their limits).

    ``labels`` (``doc_id``, ``quality``, ``toxic``) may be empty. Null texts count as empty: every labeller is silent on them. Votes are
    counted over all rows; the lists are learned from a hashed sample of about ``labelled`` labelled rows, the scorer from these,
    filled up with others to about ``sample``.
    """
    spark = docs.sparkSession
    texts, people = _texts(docs), stored(_people(labels), "quality-people")
    known = people.where("toxic is not null")
    told = known.count()
    cut = int(1_000_000 * min(1.0, labelled / max(1, told))) + 1
    chosen = texts.where(_bucket_of(F.col("doc_id")) < cut).join(known.where(_bucket_of(F.col("doc_id")) < cut), "doc_id")
    rows = chosen.select("text", "toxic").orderBy(F.xxhash64("doc_id"), "text").collect()
    words, stems = learned_lists([(r.text, r.toxic) for r in rows])
    del rows
    lists = spark.sparkContext.broadcast((words, stems))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _pieces(batch):
                found = votes(Reading(part["text"].to_list()), *lists.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "j": _coded(found, JUNK), "t": _coded(found, TOXIC)})

    voted = texts.mapInPandas(vote, "doc_id long, j long, t long").join(people, "doc_id", "left")
    voted = voted.select("doc_id", *[
        (F.col(c) - (SILENT - F.coalesce(p, F.lit(SILENT))) * 3 ** (len(names) - 1)).alias(c)
        for c, p, names in (("j", F.col("junk"), JUNK), ("t", F.col("toxic"), TOXIC))])
    voted = stored(voted, "quality-votes")
    models, total = {}, 0
    for c, names in (("j", JUNK), ("t", TOXIC)):
        counted = voted.groupBy(c).count().collect()  # at most 3 ** labellers rows
        total = sum(r["count"] for r in counted)
        patterns = decoded(np.array([r[c] for r in counted], dtype=np.int64), names) if counted else np.zeros((0, len(names)), dtype=np.int64)
        models[c] = expectation_maximisation(patterns, np.array([r["count"] for r in counted], dtype=np.float64))
    # to train on: the sample of labelled rows, whose votes include people's, filled up with others to ``sample`` rows
    other = int(1_000_000 * min(1.0, max(0, sample - min(labelled, told)) / max(1, total)))
    drawn = _bucket_of(F.col("doc_id"))
    ids = voted.where(drawn < max(cut, other)).join(known.where(drawn < cut).select("doc_id", F.lit(True).alias("told")), "doc_id", "left")
    ids = ids.where(F.col("told") | (drawn < other)).dropDuplicates(["doc_id"])
    train = texts.where(drawn < max(cut, other)).join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "text").collect()
    scorer = Scorer()
    if train:
        goal = np.stack([posterior(decoded(np.array([r[c] for r in train]), names), *models[c]) for c, names in (("j", JUNK), ("t", TOXIC))], axis=1)
        scorer.fit(*features_of([r.text for r in train]), goal)
    held = spark.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _pieces(batch):
                found = held.value.scores(Reading(part["text"].to_list()))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "junk": found[:, 0], "toxic": found[:, 1]})

    return texts.mapInPandas(score, "doc_id long, junk double, toxic double").withColumn("keep", (F.col("junk") < JUNK_LIMIT) & (F.col("toxic") < TOXIC_LIMIT))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
