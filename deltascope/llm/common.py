"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from deltascope.session import ensure_checkpoint_dir

#: Words are separated by these bytes and by nothing else.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: Bytes of text that a task holds as arrays at a time.
PIECE_BYTES = 1 << 21
#: Rows that Spark hands to a Python worker at a time.
BATCH_ROWS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def small_batches(frame: DataFrame) -> DataFrame:
    """The same frame; the session hands rows to Python workers in batches that stay small when texts are long."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return frame


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names. A null text is empty."""
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hash_sample(frame: DataFrame, order: Column, wanted: int, total: int) -> DataFrame:
    """At most `wanted` of the frame's `total` rows, those with the smallest 64-bit hashes `order`.

    Rows are first thinned out to somewhat more than are wanted, so that no task offers rows that can hardly
    be among them and the driver gets as much from many tasks as from few.
    """
    share = min(1.0, (1.3 * wanted + 200) / max(total, 1))
    near = frame.withColumn("_order", order).where(F.pmod("_order", F.lit(1 << 31)) < int(share * (1 << 31)))
    return near.orderBy(F.pmod("_order", F.lit(1 << 31)), "_order").limit(wanted).drop("_order")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder as Parquet, for results that are read several times."""
    spark = frame.sparkSession
    folder = shared_folder(spark, purpose)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the len + 1 places where they begin and end."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def extended(frame: DataFrame, **added: str) -> StructType:
    """The columns of a frame and more, by name and type."""
    return StructType([*frame.schema.fields, *(StructField(name, DataType.fromDDL(kind)) for name, kind in added.items())])
