"""Token counts by compiled finite-state transducers, without the tokens themselves.

Two transducers are read one after the other. The first splits a text as the vocabulary's pattern does; it has few states,
so a text is cut into chunks, each chunk becomes a map from entry state to exit state, the maps are composed by a parallel
prefix scan, and with every chunk's entry state known all chunks are read at once. The second reads the bytes of a piece;
its state holds what the next merge can depend on, and each transition carries the change in the number of tokens, so a
piece's count is a sum along its path. Its states are compiled when first met and kept by the worker, as are the counts
of whole pieces.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.llm import vocab
from curadrift.llm.bytepairs import PairRule
from curadrift.llm.common import query, table

LIMIT = 1024
CHUNK = 256
CHARS_AT_ONCE = 1 << 21
MOST_STATES = 400_000
MOST_PIECES = 1_500_000

# classes of characters, some with what follows: whitespace before a non-space, apostrophes of contractions
LETTER, NUMBER, OTHER, RUN, LAST_SPACE, LAST_BLANK, SHORT, LONG, END = range(9)
# states: nothing open, in letters, in numbers, in others, after a space that joins the next piece, in whitespace, one or two
# letters of a contraction to come
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
# The white space of Unicode, the letters of contractions.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDS = ["s", "t", "m", "d"]
LONG_ENDS = ["re", "ve", "ll"]


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point on its own: letter, number, whitespace (RUN) or other."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            out[code] = LETTER
        elif first == "N":
            out[code] = NUMBER
    out[WHITE] = RUN
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by state and class."""
    step = np.zeros((8, 9), dtype=np.uint8)
    begins = np.ones((8, 9), dtype=bool)
    for state in range(8):
        step[state, :END] = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, JOINING, CLOSED, ONE_MORE, TWO_MORE]
    for inside, kind in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHERS, OTHER), (IN_SPACE, RUN)):
        begins[inside, kind] = False
    begins[JOINING, [LETTER, NUMBER, OTHER, SHORT, LONG]] = False
    # an apostrophe after other signs, or after the space it joins, is one of them
    step[IN_OTHERS, [SHORT, LONG]] = step[JOINING, [SHORT, LONG]] = IN_OTHERS
    begins[IN_OTHERS, [SHORT, LONG]] = False
    step[ONE_MORE, LETTER], step[TWO_MORE, LETTER] = CLOSED, ONE_MORE
    begins[[ONE_MORE, TWO_MORE], LETTER] = False
    step[:, END], begins[:, END] = CLOSED, False
    return step, begins


def classes_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes with what follows; ``ends`` marks the separators after each text."""
    kind = character_classes()[codes]
    kind[ends] = END
    follow = np.r_[kind[1:], END]
    white = kind == RUN
    last = white & (follow != RUN) & (follow != END)
    kind[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero(codes == 39)
    at = at[kind[at] == OTHER]
    padded = np.r_[np.where(ends, 0, codes), np.zeros(2, codes.dtype)]
    one, two = padded[at + 1], padded[at + 2]
    long = np.zeros(len(at), dtype=bool)
    for a, b in LONG_ENDS:
        long |= (one == ord(a)) & (two == ord(b))
    kind[at[long]] = LONG
    kind[at[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = SHORT
    return kind


def piece_begins(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each position: chunk maps, their prefix composition, then all chunks from their entry."""
    step, begins = splitter()
    flat, width = step.ravel(), step.shape[1]
    rows = -(-len(kinds) // chunk)
    grid = np.full(rows * chunk, END, dtype=np.uint8)
    grid[:len(kinds)] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T).astype(np.intp)
    # the map of each chunk: where every entry state leads
    maps = np.tile(np.arange(8, dtype=np.intp), (rows, 1))
    for column in columns:
        maps = flat[maps * width + column[:, None]].astype(np.intp)
    # prefix scan: after round k a row holds the composition of up to 2**k chunks that end with it
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.r_[np.zeros(1, np.intp), maps[:-1, CLOSED]]
    out = np.empty((chunk, rows), dtype=bool)
    flat_begins = begins.ravel()
    for n, column in enumerate(columns):
        at = state * width + column
        out[n] = flat_begins[at]
        state = flat[at].astype(np.intp)
    return out.T.ravel()[:len(kinds)]


class Transducer:
    """Counts tokens of pieces, byte by byte. A state lists the places where a token may still be open: the trie node reached
    from there, the last token before it and the tokens up to it, relative to the tokens so far."""

    def __init__(self, tokens: list[bytes]):
        self.rule = PairRule(tokens)
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for text, number in self.rule.number.items():
            node = 0
            for byte in text:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = number
        self.forget()

    def forget(self) -> None:
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.states = {self.keys[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state: next state, and by how much the number of tokens changes."""
        moved = []
        change = last = None
        for node, before, tokens in self.keys[state]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            moved.append((after, before, tokens))
            number = self.token[after]
            if change is None and number >= 0 and (before < 0 or self.rule.fits(before, number)):
                change, last = tokens + 1, number
        key = (*((node, before, tokens - change) for node, before, tokens in moved if self.children[node]), (0, last, 0))
        after = self.states.get(key)
        if after is None:
            after = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        self.steps[state][byte] = (after, change)
        return after, change

    def count(self, piece: bytes) -> int:
        if len(self.keys) > MOST_STATES:
            self.forget()
        steps, state, total = self.steps, 0, 0
        for byte in piece:
            found = steps[state].get(byte)
            state, change = found if found is not None else self.compile(state, byte)
            total += change
        return total


class Pieces(dict):
    """Counts of whole pieces, from the transducer where they are new."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        count = self.transducer.count(piece.encode("utf-8"))
        if len(piece) <= 64:
            self[piece] = count
        return count


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    ranks = vocab.ranks(path)
    return Pieces(Transducer(sorted(ranks, key=ranks.get)))


def counts(texts: list[str], path: str, special: str = vocab.SPECIAL) -> np.ndarray:
    """Tokens of each text; the special string inside a text is one token and parts the text around it."""
    known = pieces_of(path)
    if len(known) > MOST_PIECES:
        known.clear()
    total = np.zeros(len(texts), dtype=np.int64)
    parts, owner = [], []
    for n, text in enumerate(texts):
        split = text.split(special) if special in text else [text]
        total[n] += len(split) - 1
        parts += split
        owner += [n] * len(split)
    joined = "\0".join(parts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(p) + 1 for p in parts])
    ends = np.zeros(len(codes), dtype=bool)
    ends[np.cumsum(sizes) - 1] = True
    begins = piece_begins(classes_of(codes, ends))
    cuts = np.flatnonzero(begins | ends)
    stops = cuts[1:].tolist()
    keep = ~ends[cuts[:-1]]
    found = np.fromiter((known[joined[a:b]] for a, b, k in zip(cuts[:-1].tolist(), stops, keep.tolist(), strict=True) if k),
                        dtype=np.int64, count=int(keep.sum()))
    who = np.repeat(np.array(owner), sizes)[cuts[:-1][keep]]
    return total + np.bincount(who, weights=found, minlength=len(texts)).astype(np.int64)


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].to_list()
            found = np.zeros(len(texts), dtype=np.int64)
            begin = size = 0
            for n in range(len(texts) + 1):
                if n == len(texts) or (size and size + len(texts[n]) > CHARS_AT_ONCE):
                    if n > begin:
                        found[begin:n] = counts(texts[begin:n], path)
                    begin, size = n, 0
                if n < len(texts):
                    size += len(texts[n]) + 1
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": found}).astype({"doc_id": "Int64"})

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``. ``path``: a rank file of byte-level BPE. Null
    texts count as empty, repeated rows and null ids stay; no shuffle."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    found = rows.mapInPandas(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocab.vocabulary_path("byte_bpe_50k.tiktoken"))
