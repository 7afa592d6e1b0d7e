"""Removal of long repeated strings with a run-length suffix index.

A text is a sequence of units: its bytes, or its words. Two rules use the same steps: strings of ``LENGTH`` bytes, and passages of
``PASSAGE`` words. Words stand between ASCII white space, and a character of U+3000 to U+9FFF is a word of its own.

1. Every window of so many units is assigned the leftmost least k-gram hash inside it (its anchor), so equal windows have
   equal anchors. Windows in a row with one anchor form a segment; a text gives one for every ~170 bytes.
2. Segments that share an anchor are counted. Equal segments repeat as a whole. Anchors with several different segments go
   on: one copy of each different segment, dealt by anchor into shards of bounded size.
3. A shard is indexed by a run-compressed Burrows-Wheeler transform: matches are measured only at the ends of runs, where a
   suffix and its neighbour have different left neighbours. Between those samples the length falls by one from each
   position to the next, so streaming the samples in text order gives every position's matching statistic.
4. Starts whose statistic reaches the rule's length are marked and carried back to all texts that hold the segment.

An anchor whose different segments exceed a shard (one passage met by a large share of all texts, each with its own
continuation) is settled by counting its windows one by one, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from curadrift.llm.common import by_units, parts_for, query, release, stored, table

LENGTH = 400
GRAM = 64
#: Words of a passage ("over 50"), and of its k-grams.
PASSAGE = 51
WORD_GRAM = 6
SHARD_BYTES = 2 << 20
HOT_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BYTES, WORDS = 0, 1
WHITE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


class Rule(NamedTuple):
    """A window of ``length`` units (bytes or words) and the size of its k-grams."""

    unit: int
    length: int
    gram: int


def rules_for(length: int | None, passage: int | None) -> list[Rule]:
    rules = [Rule(BYTES, length, min(GRAM, length))] if length else []
    return rules + ([Rule(WORDS, passage, min(WORD_GRAM, passage))] if passage else [])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Hashes of slices of a sequence of 64-bit symbols, from one running sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        powers = np.full(n + 1, np.uint64(BASE))
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.back = np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, begins: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[begins]) * self.back[begins])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums)
        return self.of(slice(0, max(0, n - size)), slice(size, n))


BYTE_HASHES = _mixed(np.arange(1, 257, dtype=np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of UTF-8 bytes."""
    wide = (data >= 0xE3) & (data <= 0xE9)
    inside = np.zeros(len(data) + 2, dtype=bool)
    for k in range(3):
        inside[k:len(data) + k] |= wide
    plain = ~WHITE[data] & ~inside[:len(data)]
    begin = (plain & ~np.r_[False, plain[:-1]]) | wide
    end = plain & ~np.r_[plain[1:], False]
    end[2:] |= wide[:-2]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def symbols_of(texts: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all texts end to end, and how many each text has."""
    if unit == BYTES:
        return BYTE_HASHES[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    begins, ends = word_bounds(data)
    firsts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return Sums(BYTE_HASHES[data]).of(begins, ends), np.diff(np.searchsorted(begins, firsts))


def anchors(symbols: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Segments of texts end to end: text number, first start, last start (units of the text), anchor hash."""
    ends = np.cumsum(sizes)
    empty = np.zeros(0, dtype=np.int64)
    if len(symbols) < length:
        return empty, empty, empty, empty
    hashes = Sums(symbols).grams(gram)
    window = length - gram + 1
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(order) // window)
    padded = np.full(rows * window, np.uint64(MASK))
    padded[:len(order)] = order
    grid = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(symbols) - length + 1
    least = np.minimum(behind[:starts], ahead[window - 1:window - 1 + starts])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:starts]
    valid = np.arange(starts) + length <= ends[owner]
    at[~valid] = -1
    change = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[change[1:], starts] - 1
    keep = at[change] >= 0
    change, last = change[keep], last[keep]
    who = owner[change]
    base = ends[who] - sizes[who]
    return who, change - base, last - base, hashes[at[change]].view(np.int64)


def _pieces(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _anchor_rows(rules: list[Rule]):
    """Rows ``key``, ``h`` (the anchor, its lowest bit the unit), ``seg`` (a digest that tells segments of one anchor apart), ``a``, ``b``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = [t.encode("utf-8", "surrogatepass") for t in batch["text"]], batch["key"].to_numpy()
            for i, j in _pieces(texts, PIECE_BYTES):
                part = texts[i:j]
                for unit, length, gram in rules:
                    symbols, sizes = symbols_of(part, unit)
                    who, a, b, h = anchors(symbols, sizes, length, gram)
                    first = (np.cumsum(sizes) - sizes)[who]
                    raw, width = (memoryview(b"".join(part)), 1) if unit == BYTES else (memoryview(symbols.tobytes()), 8)
                    cut = zip((first + a).tolist(), (first + b + length).tolist(), strict=True)
                    seg = np.array([xxhash.xxh3_64_intdigest(raw[s * width:e * width]) for s, e in cut], dtype=np.uint64).view(np.int64)
                    yield pd.DataFrame({"key": keys[i:j][who], "h": (h & ~np.int64(1)) | unit, "seg": seg, "a": a.astype(np.int32), "b": b.astype(np.int32)})

    return run


def suffix_order(symbols: np.ndarray, deep: int, bits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``deep`` symbols (``bits`` each), and as many symbols from each position as a number packs."""
    n, per = len(symbols), 63 // bits
    padded = np.zeros(n + per, dtype=np.int64)
    padded[:n] = symbols
    packed = np.zeros(n, dtype=np.int64)
    for i in range(per):
        packed = (packed << bits) | padded[i:i + n]
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    reach = per
    while reach < deep and rank[order[-1]] < n - 1:
        joint = rank * np.int64(n + 1)
        joint[:n - reach] += rank[reach:] + 1
        order = np.argsort(joint, kind="stable")
        ranked = joint[order]
        rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        reach *= 2
    return order, packed


def matching_statistics(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the segments (codes from 1 on, each segment followed by a separator): the longest match of the
    suffix with another one, exact up to the length of a segment; and the units left in its segment."""
    n = int(sizes.sum()) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    joined = np.zeros(n, dtype=np.int64)
    place = np.ones(n, dtype=bool)
    place[ends] = False
    joined[place] = codes
    bits = max(9, int(codes.max(initial=1)).bit_length())
    per = 63 // bits
    longest = int(sizes.max(initial=0))
    order, packed = suffix_order(joined, 2 * longest + 2, bits)
    left = joined[order - 1]
    left[0 == order] = 0
    left = np.where(left == 0, -1 - order, left)  # the first unit of a segment ends every run: no sample reaches past a separator
    heads = np.flatnonzero(left[1:] != left[:-1]) + 1
    # sampled run ends: match each head with the tail of the run before it, a packed number of symbols a step
    x, y = order[heads].copy(), order[heads - 1].copy()
    met = np.zeros(len(heads), dtype=np.int64)
    live = np.arange(len(heads))
    while len(live) and met[live[0]] <= longest:
        i, j = x[live] + met[live], y[live] + met[live]
        inside = (i < n) & (j < n)
        same = np.zeros(len(live), dtype=bool)
        same[inside] = packed[i[inside]] == packed[j[inside]]
        ended = live[inside & ~same]
        gap = packed[x[ended] + met[ended]] ^ packed[y[ended] + met[ended]]
        met[ended] += sum(((gap < np.int64(1) << np.int64(bits * t)).astype(np.int64) for t in range(1, per)), start=np.zeros(len(ended), dtype=np.int64))
        live = live[same]
        met[live] += per
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, x, met + x)
    np.maximum.at(best, y, met + y)
    stream = np.maximum.accumulate(best) - np.arange(n)
    rest = np.repeat(ends, sizes + 1) - np.arange(n)
    return stream, rest


def marked_runs(segments: list[bytes], length: int, unit: int = BYTES) -> list[list[tuple[int, int]]]:
    """Per segment: maximal runs of starts whose ``length`` units start elsewhere in the segments too."""
    if unit == BYTES:
        codes = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.int64) + 1
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
    else:
        symbols, sizes = symbols_of(segments, unit)
        codes = np.unique(symbols, return_inverse=True)[1] + 1
    stream, rest = matching_statistics(codes, sizes)
    marked = (stream >= length) & (rest >= length)
    edge = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
    begin, end = edge[::2], edge[1::2] - 1
    firsts = np.cumsum(np.r_[0, sizes + 1])
    owner = np.searchsorted(firsts, begin, side="right") - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in segments]
    for o, s, e in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
        runs[o].append((s - int(firsts[o]), e - int(firsts[o])))
    return runs


def _shard_work(lengths: dict[int, int], limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        hs, segs = rows["h"].to_numpy(), rows["bytes"].to_list()
        unit = int(hs[0] & 1)
        out, begin, size = [], 0, 0
        for i in range(len(segs) + 1):
            if i == len(segs) or (size > limit and hs[i] != hs[i - 1]):
                if i > begin:
                    out.append(pd.Series(marked_runs(segs[begin:i], lengths[unit], unit)))
                begin, size = i, 0
            if i < len(segs):
                size += len(segs[i])
        runs = pd.concat(out, ignore_index=True).to_list()
        found = pd.DataFrame({"h": hs, "seg": rows["seg"].to_numpy(), "runs": [[{"s": s, "e": e} for s, e in r] for r in runs]})
        return found[(rows["n"].to_numpy() == 1) & (found["runs"].map(len) > 0).to_numpy()]

    return run


def _windows(lengths: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                unit = int(r.h & 1)
                width = 8 if unit == WORDS else 1
                raw = symbols_of([r.bytes], unit)[0].tobytes() if unit == WORDS else r.bytes
                size = lengths[unit] * width
                starts = range(0, len(raw) - size + 1, width)
                yield pd.DataFrame({"h": r.h, "seg": r.seg, "n": r.n, "s": np.arange(len(starts), dtype=np.int32),
                                    "w": [xxhash.xxh3_128_digest(raw[s:s + size]) for s in starts]})

    return run


def _cut_segments(lengths: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # copies of a text add nothing; one that another task cuts again changes no count
        for batch in batches:
            rows = []
            for key, text, wanted in zip(batch["key"], batch["text"], batch["wanted"], strict=True):
                if bytes(key) in seen:
                    continue
                seen.add(bytes(key))
                data = text.encode("utf-8", "surrogatepass")
                begins = ends = None
                for w in wanted:
                    unit, a, b = w["h"] & 1, w["a"], w["b"] + lengths[w["h"] & 1]
                    if unit == WORDS:
                        if begins is None:
                            begins, ends = word_bounds(np.frombuffer(data, dtype=np.uint8))
                        a, b = int(begins[a]), int(ends[b - 1])
                    rows.append((w["h"], w["seg"], w["n"], data[a:b]))
            yield pd.DataFrame(rows, columns=["h", "seg", "n", "bytes"])

    return run


def text_hash(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def repeated_spans(texts: DataFrame, rules: list[Rule], hot_bytes: int | None = None) -> DataFrame:
    """``key`` and ``spans`` (array of ranges ``unit``, ``s`` to ``e`` in units, end exclusive, not merged) of the texts that hold a window
    of a rule which also starts somewhere else. ``texts``: ``key`` (binary), ``text`` (no nulls), a row for each copy; equal
    texts have equal keys. Texts without such a window have no row."""
    hot_bytes = HOT_BYTES if hot_bytes is None else hot_bytes
    lengths = {rule.unit: rule.length for rule in rules}
    length = F.lit(0)
    for unit, size in lengths.items():
        length = F.when(F.col("h").bitwiseAND(F.lit(1)) == unit, size).otherwise(length)
    anchored = texts.mapInPandas(_anchor_rows(rules), "key binary, h long, seg long, a int, b int")
    found = stored(anchored.groupBy("key", "h", "seg", "a", "b").agg(F.count("*").alias("copies")), "repeats-anchors")
    segs = stored(
        found.groupBy("h", "seg").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "a", "b")).alias("rep"))
        .join(found.groupBy("h").agg(F.sum("copies").alias("met")).where("met > 1").select("h"), "h"), "repeats-segments")
    # units of a segment; a word is taken for eight bytes
    size = (F.col("rep.b") - F.col("rep.a") + length) * F.when(F.col("h").bitwiseAND(F.lit(1)) == WORDS, 8).otherwise(1)
    shared = segs.groupBy("h").agg(F.count("*").alias("different"), F.sum(size).alias("size"))
    shared = shared.where("different > 1")
    reps = segs.join(shared.select("h"), "h").select(
        F.col("rep.key").alias("key"), F.struct("h", "seg", "n", F.col("rep.a").alias("a"), F.col("rep.b").alias("b")).alias("w"))
    wanted = reps.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    cuts = texts.join(wanted, "key").select("key", "text", "wanted").mapInPandas(
        _cut_segments(lengths), "h long, seg long, n long, bytes binary")
    cuts = stored(cuts.join(shared.select("h", "size"), "h"), "repeats-cuts")
    total = cuts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = parts_for(total, SHARD_BYTES)
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int") * 2 + F.col("h").bitwiseAND(F.lit(1)).cast("int")
    indexed = by_units(
        cuts.where(F.col("size") <= hot_bytes).withColumn("shard", shard).select("shard", "h", "seg", "n", "bytes"), ["shard"],
        _shard_work(lengths, SHARD_BYTES), "h long, seg long, runs array<struct<s:int,e:int>>")
    windows = cuts.where(F.col("size") > hot_bytes).mapInPandas(_windows(lengths), "h long, seg long, n long, s int, w binary")
    met = windows.groupBy("w").agg(F.count("*").alias("met")).where("met > 1").select("w")
    counted = windows.where("n = 1").join(met, "w").groupBy("h", "seg").agg(
        F.collect_list(F.struct("s", F.col("s").alias("e"))).alias("runs"))
    marked = indexed.unionByName(counted).unionByName(
        segs.where("n > 1").select("h", "seg", F.lit(None).cast("array<struct<s:int,e:int>>").alias("runs")))
    runs = F.coalesce(F.col("runs"), F.array(F.struct(F.lit(0).alias("s"), (F.col("b") - F.col("a")).alias("e"))))
    spans = found.select("key", "h", "seg", "a", "b").join(marked, ["h", "seg"]).select(
        "key", "a", length.alias("length"), F.col("h").bitwiseAND(F.lit(1)).cast("int").alias("unit"), F.explode(runs).alias("run"))
    out = stored(spans.groupBy("key").agg(F.collect_list(F.struct(
        "unit", (F.col("a") + F.col("run.s")).alias("s"), (F.col("a") + F.col("run.e") + F.col("length")).alias("e"))).alias("spans")), "repeats-spans")
    release(found, segs, cuts)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as maximal ones."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def byte_ranges(data: bytes, spans, unit: int) -> list[tuple[int, int]]:
    """Maximal byte ranges of a text's spans of one unit; those of words from the first word's begin to the last one's end."""
    own = merged([(int(x["s"]), int(x["e"])) for x in spans if x["unit"] == unit]) if spans is not None else []
    if unit == BYTES or not own:
        return own
    begins, ends = word_bounds(np.frombuffer(data, dtype=np.uint8))
    return [(int(begins[s]), int(ends[e - 1])) for s, e in own]


def _without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for r in ranges for x in r], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if ranges else data


def _with_spans(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``row`` (the columns of ``docs``) and ``spans``; a text is carried once."""
    keyed = docs.select(text_hash(F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    least = min(rule.length if rule.unit == BYTES else 2 * rule.length - 1 for rule in rules)
    long = docs.select(text_hash(F.col("text")).alias("key"), "text").where(F.octet_length("text") >= least)
    return keyed.join(repeated_spans(long, rules), "key", "left").select("row", "spans")


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            cut = byte_ranges(data, spans, BYTES)
            kept = _without(data, cut)
            passages = byte_ranges(data, spans, WORDS)
            rows.append((doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), len(passages), sum(e - s for s, e in passages)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]).astype({"doc_id": "Int64"})


def repeat_report(docs: DataFrame, length: int | None = None, passage: int | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``; others ignored): bytes; bytes removed by the rule of ``length`` bytes, maximal removed runs,
    digest of the rest; and the passages of ``passage`` or more repeated words (maximal runs) with their bytes, which stay.
    A null text counts as empty; repeated rows are copies of each other, so their long strings go; null ids stay null. A
    window of any share of all rows is counted before it is shuffled and split beyond ``HOT_BYTES``."""
    rules = rules_for(length or LENGTH, passage or PASSAGE)
    return _with_spans(docs.select("doc_id", "text"), rules).select("row.doc_id", "row.text", "spans").mapInPandas(
        _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


@F.pandas_udf(T.StringType())
def _kept_text(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        if found is None:
            out.append(text)
            continue
        data = text.encode("utf-8", "surrogatepass")
        ranges = []
        for s, e in byte_ranges(data, found, BYTES):
            while s < e and (data[s] & 0xC0) == 0x80:  # whole characters only
                s += 1
            while e > s and e < len(data) and (data[e] & 0xC0) == 0x80:
                e -= 1
            ranges.append((s, e))
        out.append(_without(data, merged(ranges + byte_ranges(data, found, WORDS))).decode("utf-8", "surrogatepass"))
    return pd.Series(out)


def without_repeats(docs: DataFrame, length: int | None = LENGTH, passage: int | None = None) -> DataFrame:
    """``docs`` with repeated strings of ``length`` bytes (whole characters only) and repeated passages of ``passage`` words cut out of
    ``text``, wherever they stand; either rule may be left out. All columns and rows stay, null texts too. ``n_chars``, where it
    is a column, follows the text."""
    cut = _with_spans(docs, rules_for(length, passage)).select(
        "row", _kept_text("row.text", "spans").alias("text"))
    return cut.select(*[
        F.col("text").alias("text") if c == "text"
        else F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType).alias(c)
        if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
