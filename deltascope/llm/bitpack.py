"""Token files of fixed bit width, with block offsets for random access.

A file is: a header of eight little-endian unsigned 64-bit numbers (magic, bits per id, ids per block, ids,
documents, blocks, bytes of blocks, 0); the blocks; the byte offset of each block; the first id's place of
each document and the end; the document ids (signed 64-bit) and a byte for each that is 1 if it is null.
In a block, 64 ids take `bits` unsigned 64-bit words, id k of them the bits from k * bits on.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from deltascope.llm import common, token_ids

MAGIC = 0x314B434150444942
BLOCK_IDS = 4096
#: Ids after which a file is closed, at the next document's end.
FILE_IDS = 1 << 22
_HEADER = 64


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned 64-bit words of the ids; the last group of 64 is filled with zeros."""
    groups = -(-len(ids) // 64)
    filled = np.zeros(groups * 64, np.uint64)
    filled[: len(ids)] = ids
    columns = np.ascontiguousarray(filled.reshape(groups, 64).T)
    words = np.zeros((bits, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= columns[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).ravel()


def unpack(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    groups = np.ascontiguousarray(words.reshape(-1, bits).T)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((64, groups.shape[1]), np.uint32)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = groups[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (groups[word + 1] << np.uint64(64 - shift))
        out[k] = value & mask
    return out.T.ravel()[:count]


def file_bytes(ids: np.ndarray, starts: np.ndarray, doc_ids: list, bits: int) -> bytes:
    """A whole file. starts: len(doc_ids) + 1 places in ids."""
    blocks = [pack(ids[i : i + BLOCK_IDS], bits).astype("<u8").tobytes() for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8")
    header = np.array([MAGIC, bits, BLOCK_IDS, len(ids), len(doc_ids), len(blocks), offsets[-1], 0], "<u8")
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([header.tobytes(), *blocks, offsets.tobytes(), starts.astype("<u8").tobytes(), numbers.tobytes(), nulls.tobytes()])


class TokenFile:
    """A file opened for reading; ids(a, b) reads only the blocks that hold them."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        header = np.frombuffer(self.file.read_at(_HEADER, 0), "<u8")
        if header[0] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        self.bits, self.block_ids, self.count, docs, blocks, size = map(int, header[1:7])
        tail = self.file.read_at(8 * (blocks + 1) + 8 * (docs + 1) + 9 * docs, _HEADER + size)
        self.offsets = np.frombuffer(tail, "<u8", blocks + 1).astype(np.int64)
        self.starts = np.frombuffer(tail, "<u8", docs + 1, 8 * (blocks + 1)).astype(np.int64)
        numbers = np.frombuffer(tail, "<i8", docs, 8 * (blocks + docs + 2))
        nulls = np.frombuffer(tail, np.uint8, docs, 8 * (blocks + docs + 2) + 8 * docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(numbers, nulls)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        data = self.file.read_at(int(self.offsets[last] - self.offsets[first]), _HEADER + int(self.offsets[first]))
        most = min(last * self.block_ids, self.count) - first * self.block_ids
        return unpack(np.frombuffer(data, "<u8"), self.bits, most)[start - first * self.block_ids : stop - first * self.block_ids]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder is in, as executors reach it: a mounted path, file:, hdfs:, s3: or gs:."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


FILES = "task int, number long, path string, n_ids long, n_docs long"


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each with `end_id` after it, in ascending order of the document id, and returns the table of files.

    Null texts are empty; null ids come first; rows with the same id stand in the order of their texts. Files
    hold whole documents, in the order of (task, number). A file is named for the attempt that wrote it and
    counts only if that attempt's row is in the table, so a task that runs twice does no harm.
    """
    bits = bits_for(vocabulary)

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = token_ids.library_encoder(tokenizer), TaskContext.get()
        system, path = file_system(folder)
        held: list = []
        number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, number
            ids = np.concatenate([x[1] for x in held])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))])
            doc_ids = [i for x in held for i in x[0]]
            name = f"{context.partitionId():06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(file_bytes(ids, starts, doc_ids, bits))
            row = pa.RecordBatch.from_pydict({"task": pa.array([context.partitionId()], pa.int32()), "number": [number], "path": [f"{folder}/{name}"], "n_ids": [len(ids)], "n_docs": [len(doc_ids)]})
            held, number = [], number + 1
            return row

        system.create_dir(path, recursive=True)
        for batch in batches:
            for piece in common.pieces(batch):
                ids, bounds = token_ids.with_end_ids(*encoder.encode(piece.column("text")), end_id)
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError("the vocabulary is larger than stated")
                held.append((piece.column("doc_id").to_pylist(), ids, np.diff(bounds)))
                if sum(len(x[1]) for x in held) >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    rows = common.whole_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return common.stored(ordered.mapInArrow(write_files, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and the ids' unsigned crc32."""
    placed = files.withColumn("before", F.sum("n_ids").over(Window.orderBy("task", "number")) - F.col("n_ids"))

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                file = TokenFile(path)
                checks = np.zeros(len(file.doc_ids), np.int64)
                for low in range(0, len(checks), 256):
                    high = min(low + 256, len(checks))
                    ids = file.ids(file.starts[low], file.starts[high]).astype("<u4")
                    for k in range(low, high):
                        checks[k] = zlib.crc32(ids[file.starts[k] - file.starts[low] : file.starts[k + 1] - file.starts[low]])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids, pa.int64()), "start": file.starts[:-1] + before, "n_tokens": np.diff(file.starts), "ids_crc32": checks})

    # A row here stands for a whole file: as many tasks as files, up to a few per core.
    tasks = max(1, min(files.count(), 8 * files.sparkSession.sparkContext.defaultParallelism))
    return placed.repartition(tasks).mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")
