"""Sum-of-squares packing of token sequences into windows of one length."""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common, token_ids

WINDOW = 1024
#: Windows that a task keeps open; with more, those open are completed by cutting.
OPEN_WINDOWS = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SquarePacker:
    """Places pieces one after the other.

    counts[h] is the number of open windows filled to level h. A piece goes to the level, or a new window,
    that leaves the smallest sum of squared counts; among equals to the fullest. `closed` gets each full
    window as its list of pieces (doc, start, ids, doc_tokens).
    """

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.closed: list[list] = []

    def level_for(self, size: int) -> int:
        """Level of the window that takes a piece of `size`, 0 for a new one."""
        counts, window = self.counts, self.window
        levels = np.flatnonzero(counts[1 : window - size + 1]) + 1
        if not len(levels):
            return 0
        # Moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h] + 1); a full window leaves the count.
        change = 2 * (counts[levels + size] - counts[levels] + 1) - (levels + size == window)
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * counts[size] + 1 else 0

    def add(self, doc, ids: np.ndarray) -> None:
        """A document's ids: whole windows first, then the rest as one piece."""
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.closed.append([(doc, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:].copy(), len(ids)))

    def _place(self, piece) -> None:
        size = len(piece[2])
        level = self.level_for(size)
        held = self.open[level].pop() if level else []
        held.append(piece)
        if level:
            self.counts[level] -= 1
        if level + size == self.window:
            self.closed.append(held)
        else:
            self.open[level + size].append(held)
            self.counts[level + size] += 1
            if self.counts.sum() > self.most_open:
                self.complete()

    def complete(self) -> None:
        """Fills the fullest open windows with pieces of the emptiest, cut where needed: one window at most stays partly filled."""
        windows = [(level, held) for level in sorted(self.open) for held in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        low, high = 0, len(windows) - 1
        while low < high:
            (spare, donor), (level, held) = windows[low], windows[high]
            doc, start, ids, total = donor.pop()
            taken = min(self.window - level, len(ids))
            held.append((doc, start, ids[:taken], total))
            if taken < len(ids):
                donor.append((doc, start + taken, ids[taken:], total))
            windows[low], windows[high] = (spare - taken, donor), (level + taken, held)
            if level + taken == self.window:
                self.closed.append(held)
                high -= 1
            low += not donor
        if low == high and windows[low][1]:
            level, held = windows[low]
            if level == self.window:
                self.closed.append(held)
            else:
                self.open[level].append(held)
                self.counts[level] = 1

    def finish(self) -> list[list]:
        """All windows not handed out yet, the one that is partly filled among them."""
        self.complete()
        rest = [held for level in self.open.values() for held in level]
        self.open.clear()
        self.counts[:] = 0
        done, self.closed = [*self.closed, *rest], []
        return done

    def take_closed(self) -> list[list]:
        done, self.closed = self.closed, []
        return done


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, most_open: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the documents that it reads, in one pass and without a shuffle; at its end the windows
    still open are completed, so a task pads one window at most. Null texts are empty and have the end id only;
    rows with equal ids are documents of their own; no rows give no pieces. sequence_id is the task's number
    times 2^33 plus a running number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = token_ids.library_encoder(tokenizer), SquarePacker(window, most_open), TaskContext.get().partitionId() << 33

        def rows(windows: list[list]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for held in windows:
                offset = 0
                for doc, start, ids, total in held:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset))
                    offset += len(ids)
                number += 1
            columns = zip(*out) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for piece in common.pieces(batch):
                ids, bounds = token_ids.with_end_ids(*encoder.encode(piece.column("text")), end_id)
                for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                    packer.add(doc, ids[bounds[k] : bounds[k + 1]])
                yield rows(packer.take_closed())
        yield rows(packer.finish())

    return common.whole_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(pack, PIECES)
