"""Packing along a space-filling curve.

A document's vector is the mean of pseudo-random directions hashed from its token ids, already projected to a few
dimensions. Its Hilbert key puts documents with alike vectors side by side. Token ids are stored once with their key,
range-sorted by it (ties spread by a hash of the row), and each task lays its documents end to end and cuts the line
every ``size`` ids, so only a task's last sequence can be short: it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.llm import vocab
from curadrift.llm.common import parts_for, query, stored, table

SIZE = 2048
END_ID = 1
DIMENSIONS = 3
BITS = 16
TOKENS_PER_PART = 8 << 20
#: The projections of documents lie close to 0, the more so the longer they are; this spread fills the cube.
SPREAD = 0.25


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A direction for each token id, hashed from the id: uniform in [-1, 1)."""
    x = np.arange(size * dimensions, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(40)).astype(np.float64) / 2.0 ** 23 - 1.0).reshape(size, dimensions)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below 2**bits, one row a point.

    Skilling's transform (2004), on whole columns: undo the excess rotations from the highest bit down, Gray-encode, then
    interleave the bits of the dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of vectors around 0; values beyond the spread share the outermost cells."""
    cells = np.clip((vectors / SPREAD + 1.0) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert_keys(np.nan_to_num(cells).astype(np.int64), BITS)


def _tokenise(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = vocab.byte_pair(path)
        table_of = directions(vocab.SPECIAL_ID + 1)
        for batch in batches:
            for a in range(0, len(batch), 1000):
                cut = batch.iloc[a:a + 1000]
                ids = [vocab.token_ids(t or "", encoding) for t in cut["text"]]
                sizes = np.array([len(i) for i in ids])
                line = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                sums = np.zeros((len(ids), DIMENSIONS))
                some = sizes > 0
                if some.any():
                    begins = np.r_[0, np.cumsum(sizes)[:-1]][some]
                    for d in range(DIMENSIONS):
                        sums[some, d] = np.add.reduceat(table_of[:, d][line], begins)
                yield pd.DataFrame({
                    "doc_id": cut["doc_id"].to_numpy(), "row_no": cut["row_no"].to_numpy(),
                    "curve": curve_keys(sums / np.maximum(sizes, 1)[:, None]), "n": sizes + 1,
                    "ids": [np.append(i, END_ID).astype(np.uint16).tobytes() for i in ids],
                }).astype({"doc_id": "Int64"})

    return run


def powers(rest: int) -> list[int]:
    """Ends of the powers of two, largest first, that add up to ``rest``."""
    return np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]).tolist()


class Line:
    """Lays documents end to end and cuts the line into sequences; holds the pieces of one open sequence."""

    def __init__(self, size: int, sequence: int):
        self.size, self.sequence, self.offset = size, sequence, 0
        self.open: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(self.size - self.offset, len(ids) - start)
            self.open.append((doc, start, ids[start:start + take], len(ids), self.sequence, self.offset))
            start, self.offset = start + take, self.offset + take
            if self.offset == self.size:
                yield from self.open
                self.open, self.sequence, self.offset = [], self.sequence + 1, 0

    def end(self) -> Iterator[tuple]:
        """The open sequence as sequences of a power of two."""
        bounds = powers(self.offset)
        for doc, start, ids, total, sequence, place in self.open:
            done = 0
            while done < len(ids):
                k = int(np.searchsorted(bounds, place + done, side="right"))
                take = min(len(ids) - done, bounds[k] - place - done)
                yield doc, start + done, ids[done:done + take], total, sequence + k, place + done - (bounds[k - 1] if k else 0)
                done += take


def _frame(pieces: list[tuple], with_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame({
        "doc_id": pd.array([p[0][0] for p in pieces], dtype="Int64"), "start": [p[1] for p in pieces], "length": [len(p[2]) for p in pieces],
        "ids_crc32": [zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces], "doc_tokens": [p[3] for p in pieces],
        "sequence_id": [p[4] for p in pieces], "offset": [p[5] for p in pieces], "row_no": [p[0][1] for p in pieces],
    })
    return out.assign(ids=[p[2].astype(np.int32) for p in pieces]) if with_ids else out


def _pack(size: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line = Line(size, TaskContext.get().partitionId() << 32)
        for batch in batches:
            pieces: list[tuple] = []
            for doc_id, row_no, raw in zip(batch["doc_id"], batch["row_no"], batch["ids"], strict=True):
                doc = (None if pd.isna(doc_id) else int(doc_id), row_no)
                pieces += line.add(doc, np.frombuffer(raw, dtype=np.uint16))
            if pieces:
                yield _frame(pieces, with_ids)
        if line.open:
            yield _frame(list(line.end()), with_ids)

    return run


def packed(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``row_no`` (tells
    repeated rows and null ids apart) and, if asked for, ``ids``.

    ``path``: a rank file with ids below 65,536. A null or empty text is its end id alone. Other columns are ignored. A
    sequence holds ``size`` ids or a power of two below it; a document longer than a sequence runs on in the next.
    """
    rows = docs.select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())
    held = stored(rows.mapInPandas(_tokenise(path), "doc_id long, row_no long, curve long, n long, ids binary"), "packing-ids")
    parts = parts_for(held.agg(F.sum("n")).first()[0] or 0, TOKENS_PER_PART)
    spread = held.withColumn("tie", F.xxhash64("row_no"))
    line = spread.repartitionByRange(parts, "curve", "tie").sortWithinPartitions("curve", "tie")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_no long"
    return line.select("doc_id", "row_no", "ids").mapInPandas(_pack(size, with_ids), schema + (", ids array<int>" if with_ids else ""))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocab.vocabulary_path("byte_bpe_50k.tiktoken"), with_ids=False).drop("row_no")
