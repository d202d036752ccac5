"""Collocations by phrase counts from a weighted de Bruijn graph.

Nodes are phrases of four words, edges those of five, weighted by their occurrences. Each batch of texts makes its
own part of the graph, in which it compacts unary paths: stretches whose edges all have one weight and whose inner
nodes have no other edge leave the task as one row. Spark adds up the edges of all paths. Every shorter count follows
from the flow of its nodes: a phrase occurs as often as the phrases one word longer that begin with it, and once more
for each piece that ends with it.

A phrase counts only if it is frequent, and so is then all that lies in it. Pieces are therefore cut between words
whose pair can't be frequent, and at each place the graph is followed only as far as the phrase from there can be
frequent; what stops before five words is a correction for that length, as at a piece's end. Both is read off tables
of fixed size, in which a slot holds the sum over all phrases with its hash, at least the count of each of them. So no
count of a frequent phrase changes, whatever the size of the tables; smaller ones only mean more rows. Each phrase has
TABLES slots by different bits of its hash: the rare ones that share one slot with a frequent phrase grow with the rare
ones and the frequent ones, hence with the square of the input, but hardly any share both.

The tasks are as many as cores, whatever the input: each hands on a phrase once, so that there are as many rows as
phrases times cores, not times a number of tasks that grows as well.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltascope.llm import common, words

LONGEST = 5
MOST_FREQUENT, AT_LEAST = 2000, 100
#: Tables, slots of each, and those in one row while they are summed. A slot counts up to 255.
TABLES, SLOT_BITS, ROW_BITS = 2, 24, 16
#: A longer path leaves the task in several rows.
PATH_WORDS = 256
#: Rows that a task adds up at a time; it hands them on when half as many are left.
HELD_ROWS = 1_000_000
NO_LANGUAGE = "und"
PATH, STOP, WORD, TOTAL = range(4)
PARTS = "lang string, kind int, phrase string, times long"

# Classes of bytes.
_INK, _GAP, _BREAK = range(3)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _GAP
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """Words of some texts: `codes` into `distinct`, `opens` where a piece begins, `owner` the text of each word."""

    def __init__(self, column: pa.Array):
        values, offsets = common.text_bytes(column)
        kind = _CLASS[values]
        ink = kind == _INK
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = ink[heads]
        starts = np.flatnonzero(first)
        kept = np.flatnonzero(ink)
        bounds = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(_LOWER[values[kept]]))
        coded = self.words.dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.owner = np.searchsorted(offsets, starts, side="right") - 1
        stops = np.cumsum(kind == _BREAK)[starts] if len(starts) else starts
        self.opens = np.ones(len(starts), bool)
        self.opens[1:] = (stops[1:] != stops[:-1]) | (self.owner[1:] != self.owner[:-1])


_ODD = np.uint64(0xD6E8FEB86659FD93)


def _word_keys(pieces: Pieces, seeds: np.ndarray) -> np.ndarray:
    """64-bit hash of each word in its language."""
    return words.mix(words.hashes(pieces.distinct)[pieces.codes] * _ODD + seeds[pieces.owner])


def _longer(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    return words.mix(keys * _ODD + word)


def _slots(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of the keys in each of the tables, which lie one after the other."""
    for k in range(TABLES):
        yield (keys << np.uint64(k * SLOT_BITS) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + (k << SLOT_BITS)


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    every = np.ones(len(keys), bool)
    for slot in _slots(keys):
        every &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return every


def _linked(pieces: Pieces, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each word goes on with the one before as a pair that may be frequent."""
    linked = ~pieces.opens
    at = np.flatnonzero(linked)
    linked[at] = _set(bits, _longer(keys[at - 1], keys[at]))
    return linked


def _short_phrases(pieces: Pieces, keys: np.ndarray) -> np.ndarray:
    """Keys of all words and of all pairs within pieces."""
    at = np.flatnonzero(~pieces.opens)
    return np.concatenate([keys, _longer(keys[at - 1], keys[at])])


def _long_phrases(pieces: Pieces, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Keys of the phrases of three words to LONGEST in runs of pairs that may be frequent."""
    left, longer, out = _left_in_run(_linked(pieces, keys, bits)), keys, []
    for size in range(2, LONGEST + 1):
        at = np.flatnonzero(left >= size)
        grown = np.zeros(len(keys), np.uint64)
        grown[at] = _longer(longer[at], keys[at + size - 1])
        longer = grown
        if size > 2:
            out.append(longer[at])
    return np.concatenate(out)


def _left_in_run(linked: np.ndarray) -> np.ndarray:
    """Words of the run from each word on."""
    begins = np.flatnonzero(~linked)
    ends = np.append(begins[1:], len(linked))
    return np.repeat(ends, ends - begins) - np.arange(len(linked))


def _reach(keys: np.ndarray, linked: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Words of the longest phrase from each word on that may be frequent with all its beginnings; 1 if not even its pair is."""
    left = _left_in_run(linked)
    reach, longer = np.minimum(left, 2), keys.copy()
    at = np.flatnonzero(left >= 2)
    longer[at] = _longer(keys[at], keys[at + 1])
    for size in range(3, LONGEST + 1):
        at = at[left[at] >= size]
        longer[at] = _longer(longer[at], keys[at + size - 1])
        at = at[_set(bits, longer[at])]
        reach[at] = size
    return reach


def _languages(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct languages, the number of each text's, and a hash of it."""
    coded = column.dictionary_encode()
    numbers = coded.indices.to_numpy()
    return coded.dictionary, numbers, words.hashes(coded.dictionary)[numbers]


def frequent_slots(texts: DataFrame, keys_of, at_least: int = AT_LEAST) -> np.ndarray:
    """A bit for each slot of all tables, set if its phrases occur `at_least` times together (255 at most is looked at).

    keys_of gives the keys to count of some pieces and their words' keys.
    """
    level, width, size = min(at_least, 255), 1 << ROW_BITS, TABLES << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for batch in batches:
            for piece in common.pieces(batch):
                pieces = Pieces(piece.column("text"))
                if len(pieces.codes):
                    for slot in _slots(keys_of(pieces, _word_keys(pieces, _languages(piece.column("lang"))[2]))):
                        found, times = np.unique(slot, return_counts=True)
                        held[found] = np.minimum(held[found] + times, 255)
        for k in range(0, size, width):
            part = held[k : k + width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k // width], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros(width, np.int64), 0
        for batch in batches:
            for number, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                held += np.frombuffer(counts.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "bits": pa.array([np.packbits(held >= level).tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in parts.collect():
        bits[row.part * (width // 8) : (row.part + 1) * (width // 8)] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


class Graph:
    """The de Bruijn graph of a batch.

    codes: word numbers; linked[k]: word k goes on with the run of word k - 1; lang: a number for each word; reach:
    words of the phrase that is looked at from each word on, at most LONGEST and what is left of the run.
    """

    def __init__(self, codes: np.ndarray, linked: np.ndarray, lang: np.ndarray, reach: np.ndarray | None = None):
        self.codes, self.total, self.left = codes, len(codes), _left_in_run(linked)
        self.reach = np.minimum(self.left, LONGEST) if reach is None else reach
        pair = self._renamed(codes * (lang.max(initial=0) + 1) + lang, codes, 1, self.left >= 2)
        self.node = self._renamed(pair, pair, 2, self.left >= 4)
        self.edge = self._renamed(self.node, codes, 4, self.reach >= 5)
        self.shorter = {2: pair, 3: self._renamed(pair, codes, 2, self.reach == 3), 4: self.node}
        self.node_times = np.bincount(self.node[self.node >= 0])
        self.edge_times = np.bincount(self.edge[self.edge >= 0])

    def _renamed(self, first: np.ndarray, second: np.ndarray, step: int, where: np.ndarray) -> np.ndarray:
        """Numbers of longer phrases, put together from those at a place and `step` words on; -1 elsewhere."""
        out = np.full(self.total, -1, np.int64)
        at = np.flatnonzero(where)
        if len(at):
            out[at] = np.unique(first[at] * (second.max(initial=0) + 1) + second[at + step], return_inverse=True)[1]
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and weight of each different unary path, in pieces of at most PATH_WORDS words."""
        edges = np.flatnonzero(self.edge >= 0)
        if not len(edges):
            return edges, edges, edges
        times = self.edge_times[self.edge[edges]]
        through = np.zeros(len(edges), bool)  # the path of the edge before goes on: all that passes the node between them
        follows = edges[1:] == edges[:-1] + 1
        node = self.node_times[self.node[edges[1:]]]
        through[1:] = follows & (self.left[edges[1:]] < self.left[edges[:-1]]) & (node == times[:-1]) & (node == times[1:])
        heads = np.flatnonzero(~through)
        tails = np.append(heads[1:], len(edges)) - 1
        _, once = np.unique(self.edge[edges[heads]], return_index=True)
        start, stop, weight = edges[heads[once]], edges[tails[once]] + LONGEST, times[heads[once]]
        step = PATH_WORDS - LONGEST + 1  # the pieces of a long path share four words, hence no edge
        cuts = np.maximum(-(-(stop - start - LONGEST + 1) // step), 1)
        inside = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(start, cuts) + inside * step
        return start, np.minimum(start + PATH_WORDS, np.repeat(stop, cuts)), np.repeat(weight, cuts)

    def stops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and weight of each different phrase of two words or more that is not followed up to an edge."""
        start, stop, weight = [], [], []
        for size, numbers in self.shorter.items():
            at = np.flatnonzero(self.reach == size)
            _, once, times = np.unique(numbers[at], return_index=True, return_counts=True)
            start.append(at[once])
            stop.append(at[once] + size)
            weight.append(times)
        return np.concatenate(start), np.concatenate(stop), np.concatenate(weight)


def _phrases(pieces: Pieces, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Words from each start to its stop, joined by spaces."""
    lengths = stop - start
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths) + np.repeat(start, lengths)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces.distinct.take(pa.array(pieces.codes[at])))
    return pc.binary_join(lists, " ")


def _parts(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = tables.value
        for batch in batches:
            for piece in common.pieces(batch):
                pieces = Pieces(piece.column("text"))
                names, lang, seeds = _languages(piece.column("lang"))
                if not len(pieces.codes):
                    continue
                keys = _word_keys(pieces, seeds)
                linked = _linked(pieces, keys, short)
                owner = lang[pieces.owner].astype(np.int64)
                graph = Graph(pieces.codes, linked, owner, _reach(keys, linked, long))
                for kind, (start, stop, weight) in ((PATH, graph.paths()), (STOP, graph.stops())):
                    yield _rows(names, owner[start], kind, _phrases(pieces, start, stop), weight)
                times = np.bincount(owner, minlength=len(names))
                yield _rows(names, np.arange(len(names)), TOTAL, pa.array([""] * len(names)), times)
                counted = _set(short, keys)
                found, times = np.unique((pieces.codes * len(names) + owner)[counted], return_counts=True)
                yield _rows(names, found % len(names), WORD, pieces.distinct.take(pa.array(found // len(names))), times)

    return run


def _combined(run):
    """The same rows with those of equal phrases added up before they leave the task, as long as there is room for them."""

    def combine(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        added = pa.Table.from_batches(held).group_by(["lang", "kind", "phrase"], use_threads=False).aggregate([("times", "sum")])
        columns = [added.column(name) for name in ("lang", "kind", "phrase", "times_sum")]
        return pa.table(columns, names=["lang", "kind", "phrase", "times"]).to_batches(max_chunksize=100_000)

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows in run(batches):
            held.append(rows)
            count += rows.num_rows
            if count >= HELD_ROWS:
                held = combine(held)
                count = sum(x.num_rows for x in held)
                if count > HELD_ROWS // 2:
                    yield from held
                    held, count = [], 0
        if held:
            yield from combine(held)

    return all_rows


def _rows(names: pa.Array, lang: np.ndarray, kind: int, phrases: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    columns = [names.take(pa.array(lang)), pa.array(np.full(len(lang), kind, np.int32)), phrases.cast(pa.string()), pa.array(times.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "phrase", "times"])


def graph_rows(docs: DataFrame, at_least: int = AT_LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, kind, phrase, times: paths, stops, words that may be frequent, and numbers of words, added up in each task."""
    context = docs.sparkSession.sparkContext
    texts = common.small_batches(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"))
    texts = texts.coalesce(context.defaultParallelism)
    short = frequent_slots(texts, _short_phrases, at_least)
    long = frequent_slots(texts, lambda pieces, keys: _long_phrases(pieces, keys, short), at_least)
    return texts.mapInArrow(_combined(_parts(context.broadcast((short, long)))), PARTS)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


def _cut(phrase: str, count: int) -> Column:
    return F.substring_index(phrase, " ", count)


def counts(parts: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """lang, phrase, size (1 to 5 words) and times of all phrases that occur `at_least` times."""
    edges = parts.where(F.col("kind") == PATH).select("lang", "times", F.split("phrase", " ").alias("path"))
    places = F.sequence(F.lit(1), F.size("path") - (LONGEST - 1))
    grams = F.transform(places, lambda k: F.array_join(F.slice("path", k, LONGEST), " "))
    level = _added(edges.select("lang", F.explode(grams).alias("phrase"), "times"))
    stops = parts.where(F.col("kind") == STOP).withColumn("size", F.size(F.split("phrase", " ")))
    found = level.where(F.col("times") >= at_least).withColumn("size", F.lit(LONGEST))
    for size in range(LONGEST - 1, 1, -1):
        flow = level.select("lang", _cut("phrase", size).alias("phrase"), "times")
        level = _added(flow.unionByName(stops.where(F.col("size") == size).select("lang", "phrase", "times")))
        found = found.unionByName(level.where(F.col("times") >= at_least).withColumn("size", F.lit(size)))
    single = _added(parts.where(F.col("kind") == WORD)).where(F.col("times") >= at_least)
    return found.unionByName(single.withColumn("size", F.lit(1)))


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase, by its lowest-scoring cut.

    Products are decimals of 38 digits: exact while 1000 * a * n stays below 10^38.
    """
    phrases = found.where("size > 1").select("lang", "phrase", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    halves = phrases.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    parts = found.select("lang", "phrase", "times")
    cuts = halves.join(parts.select("lang", F.col("phrase").alias("head"), F.col("times").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("times").alias("r")), ["lang", "tail"])
    wide = {name: f"cast({name} AS decimal(18, 0))" for name in "anlr"}
    score = F.expr(f"cast((cast({wide['a']} * {wide['n']} * 1000 AS decimal(38, 0))) div ({wide['l']} * {wide['r']}) AS long)")
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def whole_phrases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the phrases that are in no longer phrase as frequent as they are.

    A longer phrase with all occurrences of a shorter one has a part one word longer than it for which that is true too,
    so it is enough to look at phrases with one word more.
    """
    longer = found.where("size > 2")
    inside = longer.select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), F.col("times").alias("a"))
    return rows.join(inside.distinct(), ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, at_least: int = AT_LEAST, most: int = MOST_FREQUENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language by score.

    Null texts are empty, a null language is `und`. Repeated rows count each time. A language without phrases that
    occur `at_least` times has no rows, nor has an empty table. Other columns are not read. `at_least` above 255 keeps
    more pairs than needed, which costs work only.
    """
    parts = common.stored(graph_rows(docs, at_least, text_col, lang_col), "paths")
    found = common.stored(counts(parts, at_least), "phrases")
    totals = common.stored(parts.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("times").alias("n")).where("n > 0"), "totals")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = whole_phrases(scored(found, totals), found).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
