"""What the training-text operators share: table access, Arrow maps, bytes helpers.

Texts are handled as UTF-8 bytes in Python: ``bytes.split()`` splits at exactly
``[\\x20\\x09-\\x0D]`` and ``bytes.lower()`` lowers exactly A-Z, which is what the
operators' definitions ask for.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.shipping import ship_package

#: The bytes that separate words, and that are stripped from lines.
BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the one the session names, or, in local mode alone, a temporary one.
    What is written there stays until the session's owner clears it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docketlake-checkpoints"))


def written(df: DataFrame, name: str, page_rows: int = 20_000) -> DataFrame:
    """``df`` written to the shared folder, packed, and read again: lineage ends there, in less room than a checkpoint.
    A page, which is packed and read as a whole, has ``page_rows`` rows at most (for rows of megabytes, a few)."""
    spark = df.sparkSession
    shared_folder(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.page.row.count.limit", page_rows).parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package sent along."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores before each, as many as it takes to differ from all of ``names``."""
    held, out = {n.lower() for n in names}, []
    for w in wanted:
        w = f"_{w}"
        while w.lower() in held:
            w = f"_{w}"
        held.add(w.lower())
        out.append(w)
    return out


def chunks(texts: list[bytes], size: int = 4_000_000) -> Iterator[list[bytes]]:
    """Groups of texts of about ``size`` bytes."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def n_points(text: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def held_out(doc_id: str = "doc_id"):
    """True for documents whose labels no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


class WordIds(dict):
    """Word (bytes) to a 32-bit hash, kept for the words met last; bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = zlib.crc32(word)
        if len(word) <= 64:
            self[word] = value
        return value


WORD_IDS = WordIds()


#: Labels that a broadcast may carry: 12 bytes each, so 24 MB.
BROADCAST_LABELS = 2_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``docs`` (doc_id, text) with ``label``: null without a label, the smallest if there are several.

    The labels are broadcast only if there are at most ``BROADCAST_LABELS``; beyond that the join shuffles."""
    side = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias(label))
    if labels.count() <= BROADCAST_LABELS:
        side = F.broadcast(side)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id", "left")
