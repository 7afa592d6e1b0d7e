"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: step j writes the character the walk stands on and moves on or stays, by a bit that
depends on j and that character alone. Two texts walk together until an edit, and after it soon meet again, so a small
edit distance becomes a small Hamming distance between what the walks write (Chakraborty, Goldenberg and Koucky, 2016).
A fingerprint samples that writing: each slot takes the step of least hash among those the walk took, which hardly
depends on a text's length. Likeness is the share of equal slots. Bands of slots, themselves drawn by hash, give
candidates for near copies, verified on all slots.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from curadrift.llm.common import block_pairs, by_units, components, parts_for, query, shuffle_parts, stored, table
from curadrift.llm.jaccard import Ties, pairs_of

WALKS = 2
SLOTS = 64
PERIOD = 1 << 14
UNSET = 255
CHARS_AT_ONCE = 6 << 20
BANDS = 24
BAND_SLOTS = 8
BLOCK = 512
LEAST = 0.8
ROWS_PER_PART = 20_000
MOST_PARTS = 10_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def moves() -> np.ndarray:
    """Whether the walk moves on, by step (cyclic), walk and symbol; it never leaves a text's end."""
    draws = _mixed(np.arange(PERIOD * WALKS * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    out = ((draws >> np.uint64(40)) & np.uint64(1)).astype(np.uint8).reshape(PERIOD, WALKS, 256)
    out[:, :, UNSET] = 0
    return out.reshape(PERIOD, WALKS * 256)


@functools.lru_cache(maxsize=8)
def samples(steps: int) -> dict[int, list[tuple[int, int]]]:
    """Steps a slot takes unless a later one has a lesser hash: step -> (walk, slot)."""
    out: dict[int, list[tuple[int, int]]] = {}
    at = np.arange(steps, dtype=np.uint64)
    for walk in range(WALKS):
        slot = (_mixed(at * np.uint64(2 * WALKS) + np.uint64(2 * walk + 1)) % np.uint64(SLOTS)).astype(np.int64)
        rank = _mixed(at * np.uint64(2 * WALKS) + np.uint64(2 * walk + 2) + np.uint64(1 << 60))
        for s in range(SLOTS):
            own = np.flatnonzero(slot == s)
            low = own[rank[own] == np.minimum.accumulate(rank[own])] if len(own) else own
            for step in low.tolist():
                out.setdefault(step, []).append((walk, s))
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``WALKS * SLOTS`` symbols for each text, all walks a step at a time; 255 where a short walk took no step."""
    out = np.full((len(texts), WALKS, SLOTS), UNSET, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts) or not sizes.max():
        return out.reshape(len(texts), -1)
    codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    symbols = (_mixed(codes.astype(np.uint64)) % np.uint64(UNSET)).astype(np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols[begins + sizes] = UNSET
    steps = 1 << int(4 * sizes.max() + 64).bit_length()  # far beyond any walk; a power of two, so that the tables are few
    wanted, go = samples(steps), moves()
    who = np.repeat(np.arange(len(texts)), WALKS)
    walk = np.tile(np.arange(WALKS), len(texts))
    place, end = begins[who].copy(), (begins + sizes)[who]
    shift = walk * 256
    for step in range(steps):
        if step % 64 == 0:
            live = np.flatnonzero(place < end)
            if not len(live):
                break
            if len(live) < len(place):
                who, walk, place, end, shift = who[live], walk[live], place[live], end[live], shift[live]
        seen = symbols[place]
        for of_walk, slot in wanted.get(step, ()):
            here = np.flatnonzero((walk == of_walk) & (place < end))
            out[who[here], of_walk, slot] = seen[here]
        place += go[step & (PERIOD - 1)][shift + seen]
    return out.reshape(len(texts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either text has; 1 for two empty texts."""
    some = (a != UNSET) | (b != UNSET)
    count = some.sum(axis=-1)
    return np.where(count == 0, 1.0, ((a == b) & some).sum(axis=-1) / np.maximum(count, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a part in order, each with the text that follows; the last row of a part is a copy of the next part's first."""
    held: list[tuple] = []  # (part, copied, doc_id, text), the last one still without its follower

    def settle(rows: list[tuple]) -> pd.DataFrame | None:
        pairs = [(d, t, after[3]) for (p, copied, d, t), after in zip(rows, rows[1:], strict=False) if not copied and after[0] == p]
        if not pairs:
            return None
        # the follower's own fingerprint is needed too: every text once, the edited ones, and the last follower
        texts = [t for _, t, _ in pairs]
        changed = [edited(t, after) for _, t, after in pairs]
        index: dict[str, int] = {}
        for t in (*texts, *changed, *(after for _, _, after in pairs)):
            index.setdefault(t, len(index))
        prints = fingerprints(list(index))
        own, other = prints[[index[t] for t in texts]], prints[[index[t] for t in changed]]
        following = prints[[index[after] for _, _, after in pairs]]
        return pd.DataFrame({
            "doc_id": pd.array([d for d, _, _ in pairs], dtype="Int64"), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
            "fingerprint": [p.tobytes().hex() for p in own], "edited_fingerprint": [p.tobytes().hex() for p in other],
            "near_edited": likeness(own, other), "near_next": likeness(own, following),
        })

    size = 0
    for batch in batches:
        for part, copied, doc_id, text in zip(batch["part"], batch["copied"], batch["doc_id"], batch["text"], strict=True):
            held.append((part, copied, None if pd.isna(doc_id) else int(doc_id), text))
            size += len(text)
            if size > CHARS_AT_ONCE and len(held) > 1:
                found = settle(held)
                held, size = held[-1:], len(text)
                if found is not None:
                    yield found
    if len(held) > 1 and (found := settle(held)) is not None:
        yield found


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``), in the order of ``doc_id`` (nulls first, ties by the text's md5, the first after the last):
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hex), ``near_edited``, ``near_next``.

    Null texts count as empty; a single row is its own next. Rows are dealt to ranges of ids; each range also gets a copy of
    the first row of the next, so one shuffle of the texts is enough and no task holds more than a batch. The driver sees
    the ranges' first ids, ``MOST_PARTS`` at most.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ids = rows.select("place")
    parts = min(MOST_PARTS, max(shuffle_parts(spark), parts_for(ids.count(), ROWS_PER_PART)))
    firsts = ids.repartitionByRange(parts, "place").groupBy(F.spark_partition_id().alias("p")).agg(F.min("place").alias("first"))
    bounds = np.array(sorted(r.first_id for r in firsts.select(F.col("first").alias("first_id")).collect()), dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def homes(places: pd.Series) -> pd.Series:
        """The part of a row; for its first rows also the part before, and the last part for the very first, marked by a shift."""
        part = np.searchsorted(bounds, places.to_numpy(), side="right") - 1
        head = bounds[part] == places.to_numpy()
        before = np.where(part > 0, part - 1, len(bounds) - 1)
        return pd.Series([[int(p), -1 - int(b)] if h else [int(p)] for p, b, h in zip(part, before, head, strict=True)])

    dealt = rows.withColumn("home", F.explode(homes("place"))).select(
        F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home")).alias("part"), (F.col("home") < 0).alias("copied"), "doc_id", "place", "text")
    line = dealt.repartition("part").sortWithinPartitions("part", "copied", "place", F.md5("text"))
    return line.select("part", "copied", "doc_id", "text").mapInPandas(
        _report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (binary) of every row of ``docs``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [p.tobytes() for p in fingerprints(texts)]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint binary")


def _band_keys(prints: np.ndarray) -> np.ndarray:
    """A key for each band: slots drawn by hash."""
    drawn = (_mixed(np.arange(1, BANDS * BAND_SLOTS + 1, dtype=np.uint64)) % np.uint64(WALKS * SLOTS)).astype(np.int64).reshape(BANDS, BAND_SLOTS)
    keys = np.zeros((len(prints), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for n in range(BAND_SLOTS):
        keys = _mixed(keys * np.uint64(257) + prints[:, drawn[:, n]].astype(np.uint64))
    return keys.view(np.int64)


def near_groups(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """``fingerprint`` and ``group_id`` (the least fingerprint, as hex, of its group) for the distinct fingerprints of ``prints``:
    groups are tied by pairs that share a band and are alike in ``least`` of their slots. Equal fingerprints are one."""
    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch["fingerprint"]), dtype=np.uint8).reshape(len(batch), -1)
            yield pd.DataFrame({"fingerprint": batch["fingerprint"], "bands": list(_band_keys(matrix))})

    def verify(unit: pd.DataFrame) -> pd.DataFrame | None:
        matrix = np.frombuffer(b"".join(unit["fingerprint"]), dtype=np.uint8).reshape(len(unit), -1)
        ties = Ties(len(unit))
        for i, j in pairs_of(unit["own"].to_numpy(), unit["bi"].iat[0], unit["bj"].iat[0]):
            alike = likeness(matrix[i], matrix[j]) >= least
            ties.join(i[alike], j[alike])
        a, b = ties.links()
        names = [bytes(p).hex() for p in unit["fingerprint"]]
        return pd.DataFrame({"a": [names[k] for k in a], "b": [names[k] for k in b]}) if len(a) else None

    distinct = stored(prints.select("fingerprint").distinct(), "fingerprints")
    members = distinct.mapInPandas(banded, "fingerprint binary, bands array<long>").select("fingerprint", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    units = block_pairs(members.join(crowded, "bucket"), "bucket", "members", "fingerprint", BLOCK).select("bucket", "bi", "bj", "own", "fingerprint")
    ties = components(by_units(units, ["bucket", "bi", "bj"], verify, "a string, b string", ["fingerprint"]), "fingerprint-groups")
    name = F.lower(F.hex("fingerprint"))
    return distinct.join(ties, name == F.col("node"), "left").select("fingerprint", F.coalesce("root", name).alias("group_id"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
