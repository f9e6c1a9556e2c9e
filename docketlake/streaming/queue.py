"""A message queue on shared storage, as a streaming source with acknowledged offsets.

Publishing writes the messages as Parquet files and then enters them, under the next free number, in the queue's log:
one small file per entry, created only if it isn't there, so that of two publishers at once the second takes the next
number. The source's offset is the number of the last entry read. A trigger reads at most ``entries_per_trigger``
entries, a task one file. When a batch has been committed its offset is written as acknowledged; what comes after it is
the queue's size. A query that is killed goes on from its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from docketlake.shipping import ship_package
from docketlake.sources import log
from docketlake.streaming.messages import SCHEMA


def publish(messages: DataFrame, queue: str) -> int:
    """Append messages (of ``messages.SCHEMA``) to the queue; gives the entry's number. Nothing is seen before all is."""
    spark = messages.sparkSession
    data = f"{queue}/data/{uuid.uuid4().hex}"
    messages.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(data)
    files, place = log.place_of(queue)
    return log.enter(spark, queue, {"files": log.data_files(files, f"{place}/{data.removeprefix(queue).lstrip('/')}")})


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.queue, self.most = options["path"], int(options.get("entriesPerTrigger", 16))
        self.files, self.place = log.place_of(self.queue)
        self.given: int | None = None

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        names = log.numbers(self.files, self.place)
        begin = self.given if self.given is not None else self.acknowledged()
        ahead = [n for n in names if n > begin][: self.most]
        self.given = ahead[-1] if ahead else begin
        return {"entry": self.given}

    def acknowledged(self) -> int:
        return (log.read_json(self.files, f"{self.place}/acknowledged.json") or {"entry": 0})["entry"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.given = max(self.given or 0, end["entry"])
        entries = (log.entry(self.files, self.place, n) for n in log.numbers(self.files, self.place) if start["entry"] < n <= end["entry"])
        return [File(path) for e in entries if e for path, rows in e["files"] if rows]

    def read(self, partition: File) -> Iterator:
        with pq.ParquetFile(partition.path, filesystem=self.files, coerce_int96_timestamp_unit="us") as f:
            for b in f.iter_batches(4096):
                yield pa.RecordBatch.from_arrays([c.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(c.type) else c for c in b.columns], names=b.schema.names)

    def commit(self, end: dict) -> None:
        with self.files.open_output_stream(f"{self.place}/acknowledged.json") as f:
            f.write(json.dumps(end).encode())


class MessageQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def consume(spark: SparkSession, queue: str, entries_per_trigger: int = 16) -> DataFrame:
    """The queue's messages as a stream, in the order of the entries."""
    ship_package(spark)
    spark.dataSource.register(MessageQueue)
    return spark.readStream.format("message_queue").option("path", queue).option("entriesPerTrigger", entries_per_trigger).load()


def listen(stream: DataFrame, callbacks: list, checkpoint: str):
    """Give each micro-batch (DataFrame, its number) to every callback; one that fails doesn't keep the others from it,
    and its error goes to the query's log table when all were asked. Returns the running query."""
    errors: list[str] = []

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for f in callbacks:
            try:
                f(df, number)
            except Exception as e:
                errors.append(f"{number}: {getattr(f, '__name__', 'callback')}: {e}")
        df.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    query.callback_errors = errors
    return query


def size(spark: SparkSession, queue: str) -> int:
    """Messages that no query has acknowledged."""
    reader = Reader({"path": queue})
    done = reader.acknowledged()
    return sum(rows for n in log.numbers(reader.files, reader.place) if n > done for _, rows in log.entry(reader.files, reader.place, n)["files"])


def clear(spark: SparkSession, queue: str) -> int:
    """Acknowledge all that is there; gives how many messages went."""
    gone = size(spark, queue)
    reader = Reader({"path": queue})
    reader.commit({"entry": (log.numbers(reader.files, reader.place) or [0])[-1]})
    return gone


def pop(spark: SparkSession, queue: str) -> DataFrame:
    """What waits in the queue, as a table with its entry's number, oldest first."""
    reader = Reader({"path": queue})
    done, paths = reader.acknowledged(), []
    for n in log.numbers(reader.files, reader.place):
        if n > done:
            paths += [(n, path) for path, _ in log.entry(reader.files, reader.place, n)["files"]]
    if not paths:
        return spark.createDataFrame([], f"{SCHEMA}, entry long")
    numbers = spark.createDataFrame(paths, "entry long, file string")
    rows = spark.read.schema(SCHEMA).parquet(*(p for _, p in paths)).withColumn("file", F.regexp_replace(F.input_file_name(), "^file:/*", "/"))
    return rows.join(numbers, "file").drop("file").orderBy("entry", "timestamp", "id")
