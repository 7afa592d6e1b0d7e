"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch (white space run and what follows it; no piece reaches further) are laid end to end and their
suffixes sorted as far as the longest piece or the word reaches. Every piece is looked up by binary search, three symbols
deeper at a time, which gives the range of suffixes that begin with it: all its occurrences. Occurrences are edges between
positions; sorted by where they end, they are relaxed in order: of the edges into a position exactly one fits the last
piece before it, by the rule of byte-pair encoding on neighbours, so the path back from a word's end is its encoding.
Characters without a piece become their UTF-8 bytes. A worker keeps the ids of the words it meets again and again.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from curadrift.llm import vocab
from curadrift.llm.bytepairs import PairRule
from curadrift.llm.common import Numbered, query, table

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
CHARS_AT_ONCE = 1 << 23
INDEXED_AT_ONCE = 3 << 17
#: Words a worker keeps with their ids between batches, and their characters; beyond either, the most used half stay.
HELD_WORDS = 400_000
HELD_CHARS = 1 << 24
#: Pairs of pieces whose fit is remembered, a power of two.
HELD_PAIRS = 1 << 18
#: A symbol's bits in a key of several; the end of a word comes after all characters.
SYMBOL = 21
END = 0x110000
AT_ONCE = 3


def ragged(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of the pool, end to end."""
    total = np.cumsum(sizes)
    if not len(total) or not total[-1]:
        return pool[:0]
    return pool[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1])]


def ordering(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of non-negative integers, and the integers in it. Key and position are sorted as one integer if they fit."""
    bits = max(len(keys) - 1, 1).bit_length()
    if int(keys.max(initial=0)) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = np.sort((keys << bits) | np.arange(len(keys)))
    return packed & ((1 << bits) - 1), packed >> bits


class Held:
    """Words met so far: a number each, and by number their ids (slices of one pool) and how often they were used."""

    def __init__(self):
        self.number = Numbered()
        self.pool = np.zeros(0, dtype=np.int32)
        self.begins, self.sizes, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.chars = 0

    def trim(self) -> None:
        """When there are too many, keep the most used half of what is allowed, of those used more than once."""
        if len(self.number) <= HELD_WORDS and self.chars <= HELD_CHARS:
            return
        names = list(self.number)
        often = np.flatnonzero(self.uses > 1)
        often = often[np.argsort(-self.uses[often], kind="stable")][:HELD_WORDS // 2]
        reach = np.cumsum(np.fromiter((len(names[n]) for n in often.tolist()), dtype=np.int64, count=len(often)))
        often = often[reach <= HELD_CHARS // 2]
        self.chars = int(reach[len(often) - 1]) if len(often) else 0
        self.number = Numbered((names[n], place) for place, n in enumerate(often.tolist()))
        self.pool = ragged(self.pool, self.begins[often], self.sizes[often])
        self.sizes, self.uses = self.sizes[often], self.uses[often] // 2
        self.begins = np.cumsum(self.sizes) - self.sizes


class Pieces:
    """The vocabulary of a model: pieces in merge order for the rule, ids, byte ids, and what each id is decoded to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.runs = {text[i]: i for i in plain if set(text[i]) == {SPACE} and len(text[i]) > 1}
        singles = sorted((i for i in plain if len(text[i]) == 1), key=lambda i: text[i])
        merges = sorted((i for i in plain if len(text[i]) > 1 and text[i] not in self.runs), key=lambda i: (-model.get_score(i), i))
        self.ids = np.array(singles + merges, dtype=np.int32)
        self.rule = PairRule([text[i] for i in singles + merges])
        self.single = {text[i]: n for n, i in enumerate(singles)}
        self.space_id = model.piece_to_id(SPACE)
        self.longest = max(len(t) for t in text.values())
        kept = sorted(self.rule.number.items())
        self.sizes = np.array([len(t) for t, _ in kept])
        self.numbers = np.array([n for _, n in kept])
        # keys of several symbols, and the least and the largest that begin with what a piece has there
        symbols = np.zeros((len(kept), -(-self.longest // AT_ONCE) * AT_ONCE), dtype=np.int64)
        for row, (t, _) in enumerate(kept):
            symbols[row, :len(t)] = [ord(c) + 1 for c in t]
        free = np.where(np.arange(symbols.shape[1]) < self.sizes[:, None], 0, (1 << SYMBOL) - 1)
        weight = 1 << (SYMBOL * np.arange(AT_ONCE - 1, -1, -1))
        self.least = symbols.reshape(len(kept), -1, AT_ONCE) @ weight
        self.most = (symbols + free).reshape(len(kept), -1, AT_ONCE) @ weight
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = text[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.bytes_of[model.unk_id()] = " ⁇ ".encode()
        self.byte_number = {int(i): b for b, i in enumerate(self.byte_ids)}
        self.held = Held()
        self.pairs = np.full(HELD_PAIRS, -1, dtype=np.int64)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``PairRule.fit``, remembered for pairs met lately: a place holds the last pair dealt to it, and its answer."""
        pair = (a << 32) | b
        place = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).view(np.int64) & (HELD_PAIRS - 1)
        found = self.pairs[place]
        out = (found & 1).astype(bool)
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            out[new] = self.rule.fit(a[new], b[new])
            self.pairs[place[new]] = (pair[new] << 1) | out[new]
        return out

    @functools.lru_cache(maxsize=4096)
    def run(self, count: int) -> tuple[int, ...]:
        """Ids of white space alone: its pieces merge last and from the left, all with one score."""
        parts = [1] * count
        at = 0
        while at < len(parts) - 1:
            if SPACE * (parts[at] + parts[at + 1]) in self.runs:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return tuple(self.space_id if p == 1 else self.runs[SPACE * p] for p in parts)

    def decode(self, ids) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, the leading space goes."""
        out = b"".join([self.bytes_of[i] for i in ids])
        if not len(ids):
            return ""
        if ids[0] not in self.byte_number and out[:1] == b" ":
            out = out[1:]
        try:
            return out.decode("utf-8")
        except UnicodeDecodeError:
            return self._patched(out)

    @staticmethod
    def _patched(raw: bytes) -> str:
        """One replacement character for every byte that is part of no character."""
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def suffixes(symbols: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of the ``depth`` symbols that follow them; of ``room[i]`` symbols, if they are fewer, at
    position i. Symbols that end a word there are different from all others."""
    rank, reach = symbols.astype(np.int64), 1
    n = len(rank)
    while True:  # symbols side by side in one integer, as many as go
        base = int(rank.max(initial=0)) + 2
        joint = rank * base
        joint[:max(0, n - reach)] += rank[reach:] + 1
        reach *= 2
        if reach >= depth or (int(joint.max(initial=0)) + 2) ** 2 >> (63 - n.bit_length()):
            break
        rank = joint
    order, key = ordering(joint)
    slots = np.arange(n)
    while reach < depth and len(slots):
        # a rank is the first slot of those alike; only they are sorted further, those with symbols left
        head = np.r_[True, key[1:] != key[:-1]]
        firsts = slots[head]
        first = firsts[np.cumsum(head) - 1]
        rank[order[slots]] = first
        alike = ~(head & np.r_[head[1:], True])
        if room is not None:
            alike &= room[order[slots]] >= reach
        slots = slots[alike]
        at = order[slots]
        after = at + reach
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again, key = ordering(key)
        order[slots] = at[again]
        reach *= 2
    return order


def _bisect(values, low: np.ndarray, high: np.ndarray, goal: np.ndarray, after: bool) -> np.ndarray:
    """First index in [low, high) whose value is not below (``after``: above) the goal; all rows at once."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        found = values(mid)
        less = found <= goal[open_] if after else found < goal[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]


def occurrences(order: np.ndarray, codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Where every piece occurs: positions and rows of the piece table."""
    padded = np.r_[codes + 1, np.zeros(AT_ONCE, dtype=codes.dtype)]
    keys, inside = padded[:len(codes)] << (SYMBOL * (AT_ONCE - 1)), codes != END
    for n in range(1, AT_ONCE):  # nothing counts after the end of a word
        keys |= np.where(inside, padded[n:n + len(codes)], 0) << (SYMBOL * (AT_ONCE - 1 - n))
        inside &= padded[n:n + len(codes)] != END + 1
    begun = keys[order]
    low, high = np.searchsorted(begun, pieces.least[:, 0]), np.searchsorted(begun, pieces.most[:, 0], side="right")
    keys = np.r_[keys, np.zeros(pieces.longest, dtype=np.int64)]
    for turn in range(1, pieces.least.shape[1]):
        depth = turn * AT_ONCE
        live = np.flatnonzero((pieces.sizes > depth) & (low < high))
        if not len(live):
            break
        values = lambda at, d=depth: keys[order[at] + d]
        first = _bisect(values, low[live], high[live], pieces.least[live, turn], False)
        high[live] = _bisect(values, first, high[live], pieces.most[live, turn], True)
        low[live] = first
    sizes = np.maximum(high - low, 0)
    return ragged(order, low, sizes), np.repeat(np.arange(len(sizes)), sizes)


def encode_units(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and how many each has. A unit has at most one white space sign, its first character."""
    joined = "".join(u + "\0" for u in units)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    codes[begins + sizes] = END
    kinds = np.flatnonzero(np.bincount(codes))
    table = np.zeros(END + 1, dtype=np.int64)
    table[kinds] = np.arange(len(kinds))
    dense = table[codes]
    unit = np.repeat(np.arange(len(units)), sizes + 1)
    home = begins[unit]
    done = np.arange(len(codes)) - home
    at, row = occurrences(suffixes(dense, pieces.longest, sizes[unit] - done), codes, pieces)
    known = np.array([chr(c) in pieces.single if c < END else True for c in kinds.tolist()])
    strange = np.flatnonzero(~known[dense])
    # edges: begin, end, number of the piece; a character without a piece is an edge of its own
    reach = np.r_[pieces.sizes[row], np.ones(len(strange), dtype=np.int64)]
    number = np.r_[pieces.numbers[row], len(pieces.rule.left) + dense[strange]]
    # by the distance of the end from the word's begin, the end, the longest first
    turns, _ = ordering(done)
    turn = np.empty(len(codes), dtype=np.int64)
    turn[turns] = np.arange(len(codes))
    order, key = ordering((turn[np.r_[at, strange] + reach] << 5) + (31 - reach))
    end = turns[key >> 5]
    start = end - (31 - (key & 31))
    number = number[order]
    last = np.full(len(codes) + 1, -1, dtype=np.int64)
    back = np.zeros(len(codes) + 1, dtype=np.int64)
    single = len(pieces.rule.left) - 1  # the rule's number for what merges with nothing
    plain = np.minimum(number, single)
    inner = start != home[start]
    firsts = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])[:len(end)]
    step = done[end[firsts]]
    bounds = np.r_[0, np.flatnonzero(np.diff(step)) + 1, len(step)]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tried = firsts[lo:hi]
        while len(tried):
            fits = ~inner[tried]
            asked = np.flatnonzero(~fits)
            if len(asked):
                of = tried[asked]
                fits[asked] = pieces.fit(np.minimum(last[start[of]], single), plain[of])
            fit = tried[fits]
            last[end[fit]], back[end[fit]] = number[fit], start[fit]
            tried = tried[~fits] + 1
    cut = np.zeros(len(codes) + 1, dtype=bool)
    node, live = begins + sizes, np.flatnonzero(sizes)
    while len(live):
        cut[node[live]] = True
        node[live] = back[node[live]]
        live = live[node[live] > begins[live]]
    ends = np.flatnonzero(cut)
    found = last[ends]
    owner = unit[ends]
    counted = np.ones(len(found), dtype=np.int64)
    pool = list(pieces.ids) + [0]
    place = found.copy()
    if len(strange):
        at_char = {}
        for d in np.unique(dense[strange]).tolist():
            raw = pieces.byte_ids[np.frombuffer(chr(int(kinds[d])).encode("utf-8"), dtype=np.uint8)]
            at_char[d] = (len(pool), len(raw))
            pool += raw.tolist()
        for n in np.flatnonzero(found >= len(pieces.rule.left)).tolist():
            place[n], counted[n] = at_char[int(found[n]) - len(pieces.rule.left)]
    ids = ragged(np.array(pool, dtype=np.int32), place, counted)
    return ids, np.bincount(owner, weights=counted, minlength=len(units)).astype(np.int64)


def _learn(pieces: Pieces) -> None:
    """Index words that have a number and no ids yet, a bounded number of characters at a time, and keep their ids."""
    held = pieces.held
    done = len(held.sizes)
    # words with several white space signs: the last may join the word, the others merge among themselves
    spaced = [u for u in itertools.islice(held.number, done, None) if u[1:2] in ("", SPACE)]
    bare = [u.lstrip(SPACE) for u in spaced]
    base = held.number.line([SPACE + b for b in bare if b])
    names = list(itertools.islice(held.number, done, None))
    if not names:
        return
    plain = np.array([n for n, u in enumerate(names) if u[1:2] not in ("", SPACE)], dtype=np.int64)
    words = [names[n] for n in plain.tolist()]
    reach = np.cumsum([0, *(len(w) + 1 for w in words)])
    pools, counts, begin = [held.pool], [], 0
    while begin < len(words):
        stop = max(begin + 1, int(np.searchsorted(reach, reach[begin] + INDEXED_AT_ONCE, side="right")) - 1)
        ids, count = encode_units(words[begin:stop], pieces)
        pools.append(ids)
        counts.append(count)
        begin = stop
    begins, sizes = np.zeros((2, done + len(names)), dtype=np.int64)
    begins[:done], sizes[:done] = held.begins, held.sizes
    found = np.concatenate([*counts, np.zeros(0, dtype=np.int64)])
    sizes[done + plain] = found
    begins[done + plain] = len(held.pool) + np.cumsum(found) - found
    pool = np.concatenate(pools)
    extra, total, base = [], len(pool), iter(base.tolist())
    for unit, word in zip(spaced, bare, strict=True):
        spaces = len(unit) - len(word)
        if not word:
            ids = np.array(pieces.run(spaces), dtype=np.int32)
        else:
            b = next(base)
            own = pool[begins[b]:begins[b] + sizes[b]]
            if own[0] == pieces.space_id:
                ids = np.r_[np.array(pieces.run(spaces), dtype=np.int32), own[1:]]
            else:
                ids = np.r_[np.array(pieces.run(spaces - 1), dtype=np.int32), own]
        n = held.number[unit]
        begins[n], sizes[n] = total, len(ids)
        extra.append(ids)
        total += len(ids)
    held.pool = np.concatenate([pool, *extra]) if extra else pool
    held.begins, held.sizes, held.uses = begins, sizes, np.r_[held.uses, np.zeros(len(names), dtype=np.int64)]
    held.chars += sum(map(len, names))


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text, as the library's encoder gives them; null and empty texts have none."""
    pieces = pieces_of(path)
    held = pieces.held
    held.trim()
    lines = [held.number.line(UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []) for text in texts]
    _learn(pieces)
    if lines:
        held.uses += np.bincount(np.concatenate(lines), minlength=len(held.uses))
    return [ragged(held.pool, held.begins[line], held.sizes[line]) for line in lines]


def _batches(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    sizes = batch[column].str.len().fillna(0).to_numpy()
    begin, size = 0, 0.0
    for n in range(len(batch)):
        if n > begin and size + sizes[n] > CHARS_AT_ONCE:
            yield batch.iloc[begin:n]
            begin, size = n, 0.0
        size += sizes[n]
    if len(batch):
        yield batch.iloc[begin:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int; empty for null or empty texts) of every row of ``docs`` (``doc_id``, ``text``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _batches(batch, "text"):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": encode(part["text"].to_list(), path)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [
                pieces.decode(i.tolist()) if i is not None else "" for i in batch["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_pieces``, ``ids_crc32`` (little-endian unsigned 32-bit ids), ``round_trip`` (decoding gives the text
    again; not so for a text that holds the white space sign itself). Null texts count as empty; repeated rows stay."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(path)
        for batch in batches:
            for part in _batches(batch, "text"):
                texts = [t or "" for t in part["text"]]
                ids = encode(texts, path)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "n_pieces": [len(i) for i in ids],
                    "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                    "round_trip": [pieces.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)],
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), vocab.vocabulary_path("piece_bpe_32k.model"))
