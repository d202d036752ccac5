"""Byte-level BPE by a file of ranks: pre-tokens from class arrays and scans, cached pair merging, decoding from kept offsets."""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common, token_ids

#: Pre-tokens of more bytes are merged with a heap.
LONG = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair with the lowest rank is merged first, the leftmost among equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    none = 1 << 60
    get, bounds = ranks.get, list(range(len(word) + 1))
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            pairs[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n: parts are linked, and a heap holds pairs, stale ones included."""
    size = len(word)
    after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    alive = [True] * size
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < size and (rank := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[after[i]]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= size or end[after[i]] != stop:
            continue
        gone = after[i]
        alive[gone] = False
        end[i], after[i] = stop, after[gone]
        if after[i] < size:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(size) if alive[i]]


class Coder:
    """Encodes arrays of texts and decodes ids."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.encoder = token_ids.PretokenIds(lambda words: [merge(w.encode("utf-8"), ranks) for w in words])
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.bytes_of = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.fromiter(map(len, parts), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.decimals = [str(k) for k in range(size)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each begins and ends, from all ids and where each text's begin and end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes_of[np.arange(total) + np.repeat(self.starts[ids] - ends + lengths, lengths)]
        return data, np.concatenate([[0], ends]).astype(np.int64)[bounds]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the ids of each whole text; a null or empty text has none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for piece in common.pieces(batch):
                ids, bounds = coder.encode(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = common.whole_text(docs, id_col, text_col)
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes that the ids stand for; null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            data, places = coder.decode(lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0])
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([whole[a:b] for a, b in zip(places, places[1:])], pa.binary())], names=["doc_id", "data"])

    rows = coded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the bytes decoded from them, in one pass over the texts."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for piece in common.pieces(batch):
                ids, bounds = coder.encode(piece.column("text"))
                data, places = coder.decode(ids, bounds)
                decimals = list(map(coder.decimals.__getitem__, ids.tolist()))
                spans = list(zip(bounds.tolist(), bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(",".join(decimals[a:b]).encode()).hexdigest() for a, b in spans]),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(places.tolist(), places[1:].tolist())]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = common.whole_text(docs, id_col, text_col)
    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
