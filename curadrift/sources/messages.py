"""A folder of numbered messages as a stream that can be stopped and resumed: the offset is the last sequence number read.

Messages lie in Parquet files named after the first and last number they hold, so a trigger lists names and opens only files it
has to read, one task a file. Files are published in rising order and numbers rise from one ``append_messages`` to the next, so
whoever has read up to a number never misses an earlier one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "numbered_messages"
SCHEMA = "seq bigint, body string"
ARROW_SCHEMA = pa.schema([("seq", pa.int64()), ("body", pa.string())])
FILE_ROWS = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[int, int, str]]:
    """(first, last, path) of the published files, in order; an absent folder has none."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = [f for f in found if f.is_file and f.extension == "parquet" and not f.base_name.startswith((".", "_"))]
    return sorted((*map(int, f.base_name.split(".")[0].split("-")), f.path) for f in names)


def last_sequence(path: str) -> int:
    """The last published number, -1 without messages: a producer that was stopped appends what lies above it."""
    return max([last for _, last, _ in _files(path)], default=-1)


class MessageFile(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class MessageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.start = options["path"], int(options.get("aftersequence", "-1"))

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        return {"seq": max([last for _, last, _ in _files(self.folder)], default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[MessageFile]:
        after, upto = start["seq"], end["seq"]
        wanted = [path for first, last, path in _files(self.folder) if last > after and first <= upto]
        return [MessageFile(path, after, upto) for path in wanted or [""]]  # Spark wants a part even where there is nothing

    def read(self, partition: MessageFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, root = _store(self.folder)
        with store.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=8192, columns=["seq", "body"]):
                seq = batch.column("seq")
                yield batch.filter(pc.and_(pc.greater(seq, partition.after), pc.less_equal(seq, partition.upto))).cast(ARROW_SCHEMA)

    def commit(self, end: dict) -> None:
        """Files stay: other readers may be behind."""


class NumberedMessages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MessageReader:
        return MessageReader({k.lower(): v for k, v in dict(self.options).items()})


def message_stream(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """(seq, body) of the messages numbered above ``after``; a restarted stream goes on from its own checkpoint instead.

    Under ``availableNow`` Spark gives such a source one batch a run: after a failure that is the planned batch once more, and the next run reads on.
    """
    spark.dataSource.register(NumberedMessages)
    return spark.readStream.format(FORMAT).option("afterSequence", after).load(path)


def append_messages(df: DataFrame, seq: Column, body: Column, path: str, file_rows: int = FILE_ROWS) -> None:
    """Publish messages whose numbers all lie above those in the folder; rows with a null number are refused.

    Tasks write files into a hidden folder under names that only depend on their rows, so a task that runs again replaces its own
    file. Equal numbers share a file. The finished files then appear in rising order.
    """
    rows = df.select(seq.cast("bigint").alias("seq"), body.cast("string").alias("body"))
    low, nulls, count = rows.agg(F.min("seq"), F.count_if(F.col("seq").isNull()), F.count(F.lit(1))).first()
    if not count:
        return
    last = last_sequence(path)
    if nulls or low <= last:
        raise ValueError(f"{nulls} messages without a number, least number {low}, last number in the folder {last}")
    store, root = _store(path)
    staged = os.path.join(path, f"_staged-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, folder = _store(staged)
        sink, first, upto, attempt = None, None, None, f"{folder}/.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                first, sink = batch.column(0)[0].as_py(), pq.ParquetWriter(attempt, ARROW_SCHEMA, filesystem=out, compression="zstd")
            upto = batch.column(0)[-1].as_py()
            sink.write_batch(batch.cast(ARROW_SCHEMA))
        if sink is not None:
            sink.close()
            name = f"{first:020d}-{upto:020d}.parquet"
            out.move(attempt, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    store.create_dir(_store(staged)[1], recursive=True)
    spread = rows.repartitionByRange(-(-count // file_rows), "seq").sortWithinPartitions("seq")
    # a name a file; two attempts of a task give the same one
    for (name,) in sorted({tuple(r) for r in spread.mapInArrow(write, "name string").collect()}):
        store.move(f"{_store(staged)[1]}/{name}", f"{root}/{name}")
    store.delete_dir(_store(staged)[1])
