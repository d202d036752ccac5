"""Removal of word windows that documents with smaller ids hold too, by recompression.

A text is a row of symbols, first its words. A round names every run of equal symbols, then gives each name one
of two sides by its hash and puts a pair together where its first name is on the left side and its second on the
right. Names are hashes of the words that a symbol covers, so all tasks give equal content one name without asking
each other, and equal passages become equal symbols but for their ends.

Spark adds up over all documents, for each name, the smallest and the largest document that has it:

* Small symbols are named with the words around them that fix how they came about. Whoever holds such words has the
  symbol too, so a window around a symbol that only one document has is in no other document.
* Large symbols that a smaller document has too are repeats as a whole; all windows inside them are done.

Both answers are kept as bitmaps of a fixed size. A bit that other names share costs work and never a result: it
keeps a window that could have been passed over. What is left, windows across the edges of repeats for the most part,
is sorted by 128-bit hashes of the windows, which decides each of them exactly.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common, words

WINDOW = 13
#: Rounds after which pairs made in that round tell windows apart, and rounds whose symbols are looked up as repeats.
SMALL_ROUNDS = (2,)
LARGE_ROUNDS = (9, 13, 17)
#: Bits of each bitmap, as a power of two: 8 MB each, whatever the input.
BITMAP_BITS = 26
#: Bits of one row of a bitmap, fixed by Spark's bitmap functions.
ROW_BITS = 32768
NAMES = "key long, more long, low long, high long"
LEFT = "first long, second long, doc_id long, place long, length long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TWIST = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _powers(room: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for step in _STEPS:
        back = pow(step, -1, 1 << 64)
        out.append(tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(room, x, np.uint64))]) for x in (step, back)))
    return out


class Spans:
    """Hashes of stretches of words, each in constant time, in two lanes of 64 bits."""

    def __init__(self, hashes: np.ndarray):
        tables = _powers(1 << max(19, int(len(hashes)).bit_length()))
        self.lanes = []
        for lane, (powers, back) in enumerate(tables):
            terms = words.mix(hashes ^ np.uint64(lane * 0xA5A5A5A5)) * powers[: len(hashes)]
            self.lanes.append((np.concatenate([[np.uint64(0)], np.cumsum(terms)]), back))

    def name(self, start: np.ndarray, stop: np.ndarray, lane: int = 0) -> np.ndarray:
        sums, back = self.lanes[lane]
        return words.mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64) * _TWIST)


class Parse:
    """Rounds over the words of some documents, one after the other.

    places: the place of each document's first word, and the end. small: for each of SMALL_ROUNDS, first word and end
    of the words that fix a pair of that round. large: for each of LARGE_ROUNDS, first word and end of each symbol
    with at least a window's words.
    """

    def __init__(self, hashes: np.ndarray, places: np.ndarray, window: int = WINDOW, small: tuple = SMALL_ROUNDS, large: tuple = LARGE_ROUNDS):
        self.spans, self.hashes, self.places, self.window = Spans(hashes), hashes, places, window
        self.total = len(hashes)
        sizes = np.diff(places)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.head = np.zeros(self.total + 1, bool)
        self.head[places[:-1][sizes > 0]] = True
        self.small, self.large = [], []
        starts = np.arange(self.total)
        low, high = starts, starts + 1
        for number in range(1, max((*small, *large, 0)) + 1):
            tracked = number <= max(small, default=0)
            starts, low, high, made = self._round(starts, low, high, number, tracked)
            if number in small:
                self.small.append(self._inside(low[made], high[made], starts[made]))
            if number in large:
                ends = np.append(starts[1:], self.total)
                long = ends - starts >= window
                self.large.append((starts[long], ends[long]))

    def _inside(self, low, high, at):
        """Those of the stretches that lie in their document and in a window."""
        doc = self.owner[at]
        good = (low >= self.places[doc]) & (high <= self.places[doc + 1]) & (high - low <= self.window)
        return low[good], high[good]

    def _round(self, starts, low, high, number: int, tracked: bool):
        if not len(starts):
            return starts, low, high, np.zeros(0, bool)
        ends = np.append(starts[1:], self.total)
        names = self.spans.name(starts, ends)
        begins = np.ones(len(starts), bool)
        begins[1:] = (names[1:] != names[:-1]) | self.head[starts[1:]]
        if tracked:
            low, high = self._neighbours_differ(starts, ends, low, high, begins)
        if not begins.all():
            starts = starts[begins]
            ends = np.append(starts[1:], self.total)
            names = self.spans.name(starts, ends)
        left = words.mix(names ^ np.uint64(number * 0x9E3779B97F4A7C1)) >> np.uint64(63) == 1
        joins = np.zeros(len(starts), bool)  # with the symbol before
        joins[1:] = left[:-1] & ~left[1:] & ~self.head[starts[1:]]
        made = np.append(joins[1:], False)
        if tracked:
            low, high = self._sides_differ(starts, low, high, left, joins, made)
        keep = ~joins
        return starts[keep], low[keep] if tracked else low, high[keep] if tracked else high, made[keep]

    def _neighbours_differ(self, starts, ends, low, high, begins):
        """Widens each run's stretch until it shows that the symbols on both sides are others."""
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(starts)) - 1
        run_low, run_high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        begin, end = starts[first], ends[last]
        opens = self.head[begin]
        closes = self.head[end] | (end == self.total)
        # An edge word that differs is enough; otherwise the whole neighbour has to be known.
        own_last, own_first = self.hashes[ends[first] - 1], self.hashes[starts[last]]
        before = np.where(opens, begin, np.maximum(begin - 1, 0))
        after = np.where(closes, end - 1, np.minimum(end, self.total - 1))
        easy_low, easy_high = self.hashes[before] != own_last, self.hashes[after] != own_first
        prior, following = np.maximum(first - 1, 0), np.minimum(last + 1, len(starts) - 1)
        out_low, out_high = np.minimum(run_low, begin - 1), np.maximum(run_high, end + 1)
        hard = ~easy_low & ~opens
        out_low[hard] = np.minimum(out_low, low[prior])[hard]
        out_high[hard] = np.maximum(out_high, high[prior])[hard]
        hard = ~easy_high & ~closes
        out_low[hard] = np.minimum(out_low, low[following])[hard]
        out_high[hard] = np.maximum(out_high, high[following])[hard]
        return out_low, out_high

    def _sides_differ(self, starts, low, high, left, joins, made):
        """Widens the stretches of pairs to both parts, and of other symbols to the neighbour that left them alone."""
        out_low, out_high = low.copy(), high.copy()
        after = np.append(self.head[starts[1:]], True)
        before = self.head[starts]
        right_of = np.minimum(np.arange(len(starts)) + 1, len(starts) - 1)
        left_of = np.maximum(np.arange(len(starts)) - 1, 0)
        ends = np.append(starts[1:], self.total)
        inside = made | (left & ~after)
        out_low[inside] = np.minimum(low, low[right_of])[inside]
        out_high[inside] = np.maximum(high, high[right_of])[inside]
        alone = ~left & ~joins & ~before
        out_low[alone] = np.minimum(low, low[left_of])[alone]
        out_high[alone] = np.maximum(high, high[left_of])[alone]
        edge = left & ~made & after
        out_high[edge] = np.maximum(out_high, ends + 1)[edge]
        edge = ~left & ~joins & before
        out_low[edge] = np.minimum(out_low, starts - 1)[edge]
        return out_low, out_high


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _parsed(piece: pa.RecordBatch, window: int) -> tuple[Parse, np.ndarray]:
    codes, distinct, places = words.split(piece.column("text"))
    return Parse(words.hashes(distinct)[codes], places, window), piece.column("doc_id").to_numpy(zero_copy_only=False)


def _names(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.pieces(batch):
                parse, docs = _parsed(piece, window)
                keys, more, owners = [], [], []
                for low, high in parse.small:
                    keys.append(parse.spans.name(low, high))
                    more.append(np.zeros(len(low), np.uint64))
                    owners.append(parse.owner[low])
                for start, stop in parse.large:
                    keys.append(parse.spans.name(start, stop))
                    more.append(parse.spans.name(start, stop, 1) | np.uint64(1))
                    owners.append(parse.owner[start])
                keys, more, ids = np.concatenate(keys), np.concatenate(more), docs[np.concatenate(owners)]
                if not len(keys):
                    continue
                order = np.lexsort((ids, more, keys))
                keys, more, ids = keys[order], more[order], ids[order]
                heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]))
                tails = np.append(heads[1:], len(keys)) - 1
                yield pa.RecordBatch.from_arrays(
                    [_column(keys[heads]), _column(more[heads]), pa.array(ids[heads]), pa.array(ids[tails])], names=["key", "more", "low", "high"]
                )

    return run


def bitmaps(docs: DataFrame, window: int = WINDOW, bits: int = BITMAP_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps: small symbols that several documents have, and (large symbol, its smallest document)."""
    names = docs.mapInArrow(_names(window), NAMES).groupBy("key", "more").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mask = (1 << bits) - 1
    slots = names.where("more != 0 OR low < high").select(
        F.when(F.col("more") == 0, F.col("key").bitwiseAND(mask)).otherwise(F.col("key").bitwiseXOR(F.col("low")).bitwiseAND(mask) + (1 << bits)).alias("slot")
    )
    per_row = slots.repartition(F.expr(f"slot div {ROW_BITS}")).groupBy(F.expr(f"slot div {ROW_BITS}").alias("part"))
    found = per_row.agg(F.expr(f"bitmap_construct_agg(slot % {ROW_BITS})").alias("held"))
    out = np.zeros((2 << bits) // 8, np.uint8)
    for row in found.toLocalIterator(prefetchPartitions=True):
        out[row.part * (ROW_BITS // 8) : (row.part + 1) * (ROW_BITS // 8)] = np.frombuffer(row.held, np.uint8)
    return out[: len(out) // 2], out[len(out) // 2 :]


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _left_over(shared_bits, window: int):
    """Rows of LEFT: windows that are to be decided (length 0), and stretches of words already known as repeats.

    place holds 31 bits of the text's hash and the first word. Of a window that several documents of a batch have, only
    the smallest document's goes on; the others are repeats. So a passage that many documents share is no burden later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, firsts = shared_bits.value
        for batch in batches:
            for piece in common.pieces(batch):
                parse, docs = _parsed(piece, window)
                places, total = parse.places, parse.total
                docs = docs.astype(np.int64)
                open_ = np.zeros(total, bool)  # windows by first word
                sizes = np.maximum(np.diff(places) - window + 1, 0)
                open_[np.repeat(places[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = True
                closed, covered = np.zeros(total + 2, np.int64), np.zeros(total + 1, np.int64)
                for low, high in parse.small:
                    alone = ~_has(shared, parse.spans.name(low, high))
                    low, high = low[alone], high[alone]
                    np.add.at(closed, np.maximum(high - window, places[parse.owner[low]]), 1)
                    np.add.at(closed, low + 1, -1)
                for start, stop in parse.large:
                    again = ~_has(firsts, parse.spans.name(start, stop) ^ docs[parse.owner[start]].view(np.uint64))
                    start, stop = start[again], stop[again]
                    np.add.at(closed, start, 1)
                    np.add.at(closed, stop - window + 1, -1)
                    np.add.at(covered, start, 1)
                    np.add.at(covered, stop, -1)
                at = np.flatnonzero(open_ & (np.cumsum(closed)[:total] == 0))
                first, second, doc = parse.spans.name(at, at + window), parse.spans.name(at, at + window, 1), docs[parse.owner[at]]
                order = np.lexsort((doc, second, first))
                at, first, second, doc = at[order], first[order], second[order], doc[order]
                again = doc > _lowest(first, second, doc)[0]
                np.add.at(covered, at[again], 1)
                np.add.at(covered, at[again] + window, -1)
                at, first, second, doc = at[~again], first[~again], second[~again], doc[~again]
                text = piece.column("text_key").to_numpy(zero_copy_only=False).astype(np.int64) << 32
                owner = parse.owner[at]
                yield _left(first, second, doc, text[owner] | (at - places[owner]), np.zeros(len(at), np.int64))
                known = np.cumsum(covered)[:total] > 0
                begin, end = _stretches(known)
                cut = places[(places > 0) & (places < total)]  # stretches end with their documents
                begin, end = np.union1d(begin, cut[known[cut]]), np.union1d(end, cut[known[cut - 1]])
                owner = parse.owner[begin]
                place = text[owner] | (begin - places[owner])
                yield _left(words.mix(place.view(np.uint64)), np.zeros(len(begin), np.uint64), docs[owner], place, end - begin)

    return run


def _left(first, second, doc, place, length) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(x) for x in (first, second, doc, place, length)], names=["first", "second", "doc_id", "place", "length"])


def _lowest(first: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of each row's window, and the rows at which another window begins; rows are in that order."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    heads = np.flatnonzero(new)
    return np.repeat(doc[heads], np.diff(np.append(heads, len(first)))), heads


def _decided(window: int):
    """Stretches of repeats from rows in order of window and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_window, low = None, 0
        for batch in batches:
            first, second, doc, place, length = (column.to_numpy() for column in batch.columns)
            known = length > 0
            first, second, mine = first[~known], second[~known], doc[~known]
            lowest, heads = _lowest(first, second, mine)
            if len(first):
                if open_window == (first[0], second[0]):
                    lowest[: heads[1] if len(heads) > 1 else None] = low
                open_window, low = (first[-1], second[-1]), lowest[-1]
            repeat = known.copy()
            repeat[~known] = mine > lowest
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[repeat]), pa.array(place[repeat]), pa.array(np.where(length == 0, window, length)[repeat])], names=["doc_id", "place", "length"]
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping stretches of each document put together."""
    for batch in batches:
        begins, ends = [], []
        for begin, length in zip(batch.column("begins"), batch.column("lengths")):
            begin, length = begin.values.to_numpy(), length.values.to_numpy()
            order = np.argsort(begin)
            begin, end = begin[order], np.maximum.accumulate((begin + length)[order])
            new = np.append(True, begin[1:] > end[:-1])
            begins.append(begin[new])
            ends.append(end[np.append(new[1:], True)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "text_key", "begins", "ends"]
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in common.pieces(batch):
            codes, distinct, places = words.split(piece.column("text"))
            gone = np.zeros(len(codes) + 1, np.int64)
            for name, sign in (("begins", 1), ("ends", -1)):
                column = piece.column(name)
                counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
                at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(places[:-1], counts)
                np.add.at(gone, at, sign)
            stay = np.cumsum(gone)[: len(codes)] == 0
            kept = distinct.take(pa.array(codes[stay])).to_pylist()
            bounds = np.concatenate([[0], np.cumsum(stay)])[places]
            digests = [hashlib.sha256(" ".join(kept[bounds[k] : bounds[k + 1]]).encode()).hexdigest() for k in range(len(places) - 1)]
            sizes, left = np.diff(places), np.diff(bounds)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes), pa.array(sizes - left), pa.array(digests, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])


def without_repeats(docs: DataFrame, window: int = WINDOW, bits: int = BITMAP_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document, as its words are after removal.

    A word goes if a window of `window` consecutive words around it also starts in a document with a smaller id.
    Null texts have no words; texts shorter than a window keep all of theirs. Rows with equal ids are documents of
    their own, none of which is smaller than another; a document without an id is smaller than none, and none is
    smaller than it. Other columns are not read. No rows give no rows.
    """
    texts = common.whole_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = texts.withColumn("text_key", F.xxhash64("text").bitwiseAND((1 << 31) - 1))
    named = keyed.where("doc_id IS NOT NULL AND text != ''")
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps(named, window, bits))
    left = named.mapInArrow(_left_over(shared, window), LEFT).repartition("first", "second").sortWithinPartitions("first", "second", "doc_id")
    again = left.mapInArrow(_decided(window), "doc_id long, place long, length long")
    key, start = F.shiftright("place", 32), F.col("place").bitwiseAND((1 << 32) - 1)
    # A document has at most as many of these as words.
    found = again.groupBy("doc_id", key.alias("text_key")).agg(F.collect_list(start).alias("begins"), F.collect_list("length").alias("lengths"))
    found = found.mapInArrow(_merged, "doc_id long, text_key long, begins array<long>, ends array<long>")
    joined = keyed.join(common.stored(found, "repeats"), ["doc_id", "text_key"], "left").select("doc_id", "text", "begins", "ends")
    return common.small_batches(joined).mapInArrow(_kept, RESULT)
