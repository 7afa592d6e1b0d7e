"""Token ids in binary files of independent Zstandard frames with a trailing seek table.

A file, all numbers little-endian:

* frames of ids: the documents' ids end to end, ``FRAME_IDS`` ids a frame, two bytes an id (four if the vocabulary needs it);
* frames of the directory: for each document its id (8 bytes, 0 if null), its number of ids (8 bytes) and 1 byte, 0 for a null id;
* a skippable frame: bytes an id, documents, ids, ids a frame;
* a skippable frame with the seek table of the public seekable format: for every frame its compressed and its decompressed size and a
  checksum (low half of XXH64 of the content), then the number of frames, a descriptor and the magic number.

A reader finds the seek table from the end of a file, from it the directory, and then decompresses and checks only the frames
that hold the documents asked for. Zstandard tools read the files as one stream.

Documents are range-partitioned by ``doc_id``; a task writes files of bounded size under names of its own attempt. The
manifest, a table written by Spark's commit protocol, names the files that count, so a lost or repeated task adds nothing. Files
go through pyarrow file systems: local and mounted folders, and stores whose client library the workers have.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from curadrift.llm import vocab
from curadrift.llm.common import parts_for, query, stored, table
from curadrift.operators.ordered import PART, ranged, running
from curadrift.session import fresh_path

END_ID = 1
FRAME_IDS = 1 << 16
FILE_IDS = 8 << 20
LEVEL = 3
HELD_CHUNKS = 400_000
# Fixed values of the seekable format and of the tokenizer.
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SKIPPABLE_INFO = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
INFO = "<IQQI"
SPACES = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F) + "]+")
ODD_SPACES = re.compile(r"[\x1c-\x1f]")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = re.compile("(?!)")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_signs() -> dict[int, str]:
    """The signs that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others by number from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder(dict):
    """Packed ids of chunks, as the library gives them; the library's model is asked once for a word, until too many are held.

    The tokenizer drops white space and lets nothing reach across it, so a text's ids are those of its chunks. A chunk of
    printable ASCII and Latin-1 letters only has no other normal form, so lower case and the tokenizer's own split pattern
    give the words that go to the library's model; any other chunk goes through the whole of the library. Strings of special
    tokens inside a text stay one id, as is the library's default.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.wide = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1) > 1 << 16
        self.code = "I" if self.wide else "H"
        self.added = {text: array(self.code, [i]).tobytes() for text, i in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.end = array(self.code, [END_ID]).tobytes()
        self.words: dict[str, bytes] = {}
        self.signs = byte_signs()
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if spec["pre_tokenizer"]["type"] == "Sequence" else None
        self.plain = PLAIN if split == SPLIT else NEVER  # of another tokenizer everything goes through the whole library

    def __missing__(self, chunk: str) -> bytes:
        if self.plain.fullmatch(chunk):
            found = b"".join([self.words.get(w) or self._word(w) for w in WORDS.findall(chunk.lower())])
        else:
            found = array(self.code, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        found = self.words[word] = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def chunks(self, text: str) -> list[str]:
        if self.marks is not None and "<" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else self._split(p))]
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        return [c for c in SPACES.split(text) if c] if ODD_SPACES.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, the end id last, as packed numbers."""
        if len(self) > HELD_CHUNKS:
            self.clear()
        if len(self.words) > HELD_CHUNKS:
            self.words.clear()
        self.update(self.added)
        return [b"".join(map(self.__getitem__, self.chunks(t))) + self.end if t else self.end for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    gc.freeze()
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        width = 4 if coder.wide else 2
        for batch in batches:
            for a in range(0, len(batch), 500):
                cut = batch.iloc[a:a + 500]
                ids = coder.encode(cut["text"].to_list())
                yield pd.DataFrame({"doc_id": cut["doc_id"].astype("Int64"), "row_no": cut["row_no"], "width": width,
                                    "n": [len(i) // width for i in ids], "crc": [zlib.crc32(i) for i in ids], "ids": ids})

    return run


class Writer:
    """One file; documents are added in order."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.open, self.size, self.ids, self.directory = [], 0, 0, []

    def _frame(self, content: bytes) -> None:
        packed = self.press.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _full(self, least: int, frame: int) -> None:
        """Write whole frames while at least so many bytes are open."""
        if self.size >= least and self.size:
            line = b"".join(self.open)
            at = 0
            while len(line) - at >= least and at < len(line):
                self._frame(line[at:at + frame])
                at += frame
            self.open, self.size = [line[at:]], max(0, len(line) - at)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.open.append(ids)
        self.size += len(ids)
        self.ids += len(ids) // self.width
        self.directory.append((0 if doc_id is None else doc_id, len(ids) // self.width, doc_id is not None))
        self._full(self.frame_ids * self.width, self.frame_ids * self.width)

    def close(self) -> None:
        frame = self.frame_ids * self.width
        self._full(1, frame)
        rows = np.array(self.directory, dtype=[("doc_id", "<i8"), ("n", "<i8"), ("known", "u1")]).tobytes()
        for at in range(0, len(rows), frame):
            self._frame(rows[at:at + frame])
        info = struct.pack(INFO, self.width, len(self.directory), self.ids, self.frame_ids)
        self.out.write(struct.pack("<II", SKIPPABLE_INFO, len(info)) + info)
        self.table.append((8 + len(info), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = np.array(self.table, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class Reader:
    """One file, opened for random access. ``frames_read`` counts the frames decompressed."""

    def __init__(self, source):
        self.source, self.frames_read = source, 0
        size = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.press = zstandard.ZstdDecompressor()
        info = source.read_at(struct.calcsize(INFO), int(self.at[-1]) + 8)
        self.width, self.docs, self.ids, self.frame_ids = struct.unpack(INFO, info)
        self.id_frames = -(-self.ids // self.frame_ids)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.table[k].tolist()
        content = self.press.decompress(self.source.read_at(packed, int(self.at[k])), max_output_size=size)
        self.frames_read += 1
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not agree with its checksum")
        return content

    def directory(self) -> pd.DataFrame:
        """``doc_id``, ``n`` and ``first``: the ids of the file before the document."""
        content = b"".join(self.frame(k) for k in range(self.id_frames, len(self.table) - 1))
        rows = np.frombuffer(content, dtype=[("doc_id", "<i8"), ("n", "<i8"), ("known", "u1")])
        ids = pd.array(rows["doc_id"], dtype="Int64")
        ids[rows["known"] == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n": rows["n"], "first": np.cumsum(rows["n"]) - rows["n"]})

    def documents(self, firsts: list[int], sizes: list[int]) -> Iterator[np.ndarray]:
        """Ids of documents in the order of their places; each frame that holds one is read once, the others not at all."""
        here, content = -1, b""
        kind = "<u4" if self.width == 4 else "<u2"
        for first, n in zip(firsts, sizes, strict=True):
            parts = []
            for k in range(first // self.frame_ids, -(-(first + n) // self.frame_ids)):
                if k != here:
                    here, content = k, self.frame(k)
                begin = k * self.frame_ids
                parts.append(content[max(first - begin, 0) * self.width:max(first + n - begin, 0) * self.width])
            yield np.frombuffer(b"".join(parts), dtype=kind)


def _store(folder: str):
    from pyarrow import fs

    if "://" not in folder and ":/" not in folder:
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, file_ids: int, frame_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _store(folder)
        files.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        number, out, writer = 0, None, None

        def ended() -> pd.DataFrame:
            writer.close()
            out.close()
            return pd.DataFrame([(part << 20 | number, f"part-{part:06d}-{number:05d}-{attempt}.ids.zst", len(writer.directory), writer.ids)],
                                columns=["file_no", "file", "docs", "ids"])

        for batch in batches:
            for doc_id, width, ids in zip(batch["doc_id"].astype("Int64"), batch["width"], batch["ids"], strict=True):
                if writer is not None and writer.ids >= file_ids:
                    yield ended()
                    number, writer = number + 1, None
                if writer is None:
                    out = files.open_output_stream(f"{base}/part-{part:06d}-{number:05d}-{attempt}.ids.zst", compression=None)
                    writer = Writer(out, int(width), frame_ids)
                writer.add(None if pd.isna(doc_id) else int(doc_id), ids)
        if writer is not None:
            yield ended()

    return run


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, file_ids: int = FILE_IDS, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode the texts of ``docs`` (``doc_id``, ``text``; other columns are ignored) by the tokenizer file ``path``, append the end
    id and write all in ascending ``doc_id`` into files of ``folder`` (a new one of the shared folder if none is given).

    Returns the manifest: ``folder``, ``file``, ``file_no`` (ascending as the files follow each other), ``docs``, ``ids``, ``start`` (ids in
    the files before). Null ids come first, equal ids in the order of a checksum of their ids; a null or empty text is its end id
    alone; repeated rows are documents of their own; an empty table has no files.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    rows = docs.select("doc_id", "text").withColumn("row_no", F.monotonically_increasing_id())
    held = stored(rows.mapInPandas(_encode(path), "doc_id long, row_no long, width int, n long, crc long, ids binary"), "token-files-ids")
    parts = parts_for(held.agg(F.sum("n")).first()[0] or 0, file_ids)
    order = ["doc_id", "crc", "spread"]
    line = held.withColumn("spread", F.xxhash64("row_no")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = stored(line.select("doc_id", "width", "ids").mapInPandas(
        _write(folder, file_ids, frame_ids), "file_no long, file string, docs long, ids long"), "token-files-manifest")
    placed = running(ranged(written, [], ["file_no"]), [], ["file_no"], sums={"upto": F.col("ids")})
    return placed.select(F.lit(folder).alias("folder"), "file", "file_no", "docs", "ids", (F.col("upto") - F.col("ids")).alias("start"))


def _read(with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                files, base = _store(row.folder)
                with files.open_input_file(f"{base}/{row.file}") as source:
                    reader = Reader(source)
                    listed = reader.directory()
                    for a in range(0, len(listed), 1000):
                        cut = listed.iloc[a:a + 1000]
                        ids = list(reader.documents(cut["first"].tolist(), cut["n"].tolist()))
                        out = pd.DataFrame({
                            "doc_id": cut["doc_id"], "start": cut["first"] + row.start, "n_tokens": cut["n"],
                            "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]})
                        yield out.assign(ids=[i.astype(np.int32) for i in ids]) if with_ids else out

    return run


def _a_file_a_task(manifest: DataFrame) -> DataFrame:
    """A counted number of partitions, which adaptive execution leaves as it is: rows are few, what they stand for is not."""
    files = manifest.select("folder", "file", "start", "file_no")
    return files.repartitionByRange(max(1, files.count()), "file_no")


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` of all documents of the files of a manifest."""
    return _a_file_a_task(manifest).mapInPandas(_read(with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))


def _located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            files, base = _store(row.folder)
            with files.open_input_file(f"{base}/{row.file}") as source:
                listed = Reader(source).directory()
            for a in range(0, len(listed), 100_000):
                yield listed.iloc[a:a + 100_000].assign(folder=row.folder, file=row.file, start=row.start)


def _read_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, source, reader = None, None, None
    for batch in batches:
        for (folder, file), part in batch.groupby(["folder", "file"], sort=False):
            if (folder, file) != name:
                if source is not None:
                    source.close()
                files, base = _store(folder)
                name, source = (folder, file), files.open_input_file(f"{base}/{file}")
                reader = Reader(source)
            ids = list(reader.documents(part["first"].tolist(), part["n"].tolist()))
            yield pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64").to_numpy(), "start": (part["first"] + part["start"]).to_numpy(), "n_tokens": part["n"].to_numpy(),
                "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], "ids": [i.astype(np.int32) for i in ids]}).astype({"doc_id": "Int64"})
    if source is not None:
        source.close()


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose ``doc_id`` is in ``wanted``, as ``read_token_files`` gives them: directories are joined with it, and only
    frames that hold one of them are decompressed. Ids that no file holds, and nulls, have no row."""
    places = _a_file_a_task(manifest).mapInPandas(
        _located, "doc_id long, n long, first long, folder string, file string, start long")
    asked = places.join(wanted.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id")
    return asked.repartition("folder", "file").sortWithinPartitions("folder", "file", "first").mapInPandas(_read_places, SCHEMA + ", ids array<int>")


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocab.vocabulary_path("word_bpe_49k.json")), with_ids=False)
